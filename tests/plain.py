"""Plain versions of the similarities, to hold the library against."""


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each letter of ``b``."""
    place: dict[str, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & place.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def token_set_of(a: str, b: str) -> float:
    """The best ratio among the shared words and either side's words in order."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio_of(one, two)]
    return max([*found, ratio_of(both, one), ratio_of(both, two)] if both else found)
