"""Tokens, packing, pieces, toxicity and languages."""

import array
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from docproof.llm import language_id, pieces, toxicity
from docproof.llm.common import table
from docproof.llm.encoders import byte_bpe_counter, word_bpe
from docproof.llm.packing import CAPACITY, cut, pack
from docproof.llm.queries import op1_token_counts
from docproof.llm.token_counts import Rollup, deletes, inserts, revisions

ODD = ["", " ", "a  b", "\n", "x\n\ny ", "▁▁a", "日本語 テスト", "a\0b", "😀é", "<s> </s> <0x0A>", "It's, isn't.. ''s,", "ΟΔΟΣ İ", "é", "a\x1cb", "<|endoftext|>,", "½²٣", "\n  b"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    random.seed(5)
    made = ["".join(random.choice("aB'sStTre.,!? \n\t_-1é 😀Σ") for _ in range(random.randrange(20))) for _ in range(400)]
    return [r["text"] for r in table(spark, sf_dir, "documents").collect()] + ODD + made


def test_word_bpe_is_the_librarys(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = tokenizers.Tokenizer.from_file(path), word_bpe(path)
    for text in texts:
        assert array.array("I", ours(text)).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_byte_counts_are_the_librarys(texts):
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe_counter(path)
    assert [ours(t) for t in texts] == [len(library.encode_ordinary(t)) for t in texts]


def test_pieces_are_the_librarys(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    for text in texts:
        ids, first, end = ours.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert ours.decode(ids.tolist()) == library.decode(ids.tolist())
        data = text.encode()
        assert end[-1] == len(data) and (first <= end).all() and (not data or first[0] == 0)
        normal, source = ours.normalise(text)
        assert normal.decode() == ours.aligned(text)[0]
    random.seed(1)
    for _ in range(2000):
        some = [random.choice([random.randrange(300), random.randrange(32000)]) for _ in range(random.randrange(12))]
        assert ours.decode(some) == library.decode(some)


def _trie(entries):
    """A character map as its file holds it, from {prefix: replacement}; a plain double array."""
    units, replacements, used = [0] * 4096, b"", {0}
    values = {}
    for key, value in entries.items():
        values[key] = len(replacements)
        replacements += value + b"\0"

    def place(node, keys, depth):
        labels = sorted({k[depth] if depth < len(k) else -1 for k in keys})
        base = next(b for b in range(1, 3000) if all((b ^ max(x, 0)) not in used for x in labels) and (node ^ b) < 1 << 21)
        units[node] |= (node ^ b if False else base ^ node) << 10
        for x in labels:
            used.add(base ^ max(x, 0))
        for x in labels:
            mine = [k for k in keys if (k[depth] if depth < len(k) else -1) == x]
            if x == -1:
                units[node] |= 1 << 8
                units[base] = values[mine[0]] | 1 << 31
            else:
                units[base ^ x] = x
                place(base ^ x, mine, depth + 1)

    place(0, list(entries), 0)
    import struct

    body = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(body)) + body + replacements


def test_character_map_takes_the_longest_prefix():
    found = pieces.CharMap(_trie({"ﬁ".encode(): b"fi", b"e": b"E", "é".encode(): "é".encode(), "½".encode(): b"1/2"}))
    assert found.longest("ﬁn".encode(), 0) == (3, b"fi")
    assert found.longest("é".encode(), 0) == (3, "é".encode())
    assert found.longest(b"ex", 0) == (1, b"E")
    assert found.longest(b"x", 0) is None
    ours = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    mapped = pieces.Pieces.__new__(pieces.Pieces)
    mapped.__dict__ |= ours.__dict__ | {"map": found, "squeeze": True}
    normal, source = mapped.normalise("  ﬁ  é ")
    assert normal.decode() == "▁fi▁é" and source[3] == 2 and source[5] == 5 and source[-1] == 10


def test_map_walk_and_offsets_are_the_librarys(texts):
    """With a real character map: the library's own NFKC rules, its normaliser and its offsets (in characters)."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(pieces.fields(next(v for k, v in pieces.fields(library.serialized_model_proto()) if k == 3)))
    mapped = pieces.Pieces.__new__(pieces.Pieces)
    mapped.map, mapped.dummy_prefix, mapped.squeeze, mapped.escape = pieces.CharMap(spec[2]), True, True, True
    assert mapped.map.longest("①".encode(), 0) == (3, b"1") and len(mapped.map.units) > 10_000
    random.seed(8)
    odd = ["".join(random.choice("ﬁ①½Ａé\u0301ｱﾞ㍿ \u3000\t\n\u200bx.한ｶﾞ") for _ in range(random.randrange(25))) for _ in range(600)]
    for text in [*odd, *texts[:150], *ODD]:
        if "\0" in text:
            continue
        normal, source = mapped.normalise(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == want, text
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        starts = np.cumsum([0, *(len(c.encode()) for c in want)])
        if want:
            assert source[starts].tolist() == at[offsets].tolist(), text


def test_pieces_in_tables(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"] or 0), r["decoded"], len(r["ids"]), r["end"][-1]) for r in pieces.decode_pieces(pieces.encode_pieces(docs, path), path).collect())
    assert got == [(0, "a b", 3, 3), (1, "", 1, 0), (3, "", 1, 0), (3, "", 1, 0)]
    assert pieces.encode_pieces(docs.limit(0), path).count() == 0


def test_cut():
    for n in [1, 5, 63, 64, 65, 1000, 1024, 1500, 2047, 2048, 2049, 9999]:
        assert sum(cut(n)) == n and max(cut(n)) <= CAPACITY


def test_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").withColumn("offset", F.lit("clash")).unionByName(spark.createDataFrame([(-1, None, "x", "y", 1, "c"), (-2, "", "x", "y", 1, "c"), (None, "alone", "x", "y", 1, "c")], "doc_id long, text string, lang string, source string, n_chars long, offset string"))
    rows = pack(docs, path).collect()
    encode = word_bpe(path)
    want = {(r["doc_id"]): encode(r["text"] or "") + b"\1\0\0\0" for r in docs.collect()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == want[doc] and all(r["doc_tokens"] == len(want[doc]) // 4 for r in parts)
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
    padding = 0
    for parts in by_bin.values():
        parts.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in parts)
        assert size <= CAPACITY and [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        padding += 0 if size & (size - 1) == 0 else CAPACITY - size
    assert padding < 0.03 * sum(r["length"] for r in rows)
    assert pack(docs.limit(0), path).count() == 0


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "v", 5), ("s", "en", "v", 7), (None, None, "v", 2), ("t", "fr", "v", 0)], "source string, lang string, tokenizer string, tokens long")
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.read().count() == 0
    assert rollup.apply("one", inserts(rows)) and not rollup.apply("one", inserts(rows))
    assert rollup.apply("two", deletes(rows.where("tokens = 7")))
    assert rollup.apply("three", revisions(rows.where("source is null").withColumn("now", F.lit(11).cast("long")), "tokens", "now"))
    state = lambda: sorted(map(str, (tuple(r) for r in rollup.read().collect())))
    before = state()
    assert before == sorted(map(str, [("s", "en", "v", 1, 5), (None, None, "v", 1, 11), ("t", "fr", "v", 1, 0)]))
    rollup.compact()
    assert state() == before and rollup.batches() == {"one", "two", "three"} and not rollup.apply("two", inserts(rows))
    rollup.apply("four", deletes(rows.where("tokens = 0")))
    assert len(state()) == 2 and not rollup.apply("one", inserts(rows))


def test_rollup_of_two_writers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v2", 8)], "source string, lang string, tokenizer string, tokens long")
    folder = f"file://{tmp_path}/r"
    one, two = Rollup(spark, folder), Rollup(spark, folder)
    commit = one._commit

    def late(*args):  # the second writer commits after the first has looked
        assert two.apply("a/b", inserts(rows))
        return commit(*args)

    one._commit = late
    assert not one.apply("a/b", inserts(rows))
    one._commit = commit
    want = [("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 8)]
    assert sorted(map(tuple, one.read().collect())) == want and one.batches() == {"a/b"}
    assert one.apply("c", inserts(rows)) and one.apply("d", deletes(rows))
    assert one.compact() and not two.compact() and one.apply("e", inserts(rows)) and one.compact()
    one.vacuum()
    assert sorted(map(tuple, two.read().collect())) == [(*k, 2 * d, 2 * t) for *k, d, t in want]
    assert not two.apply("a/b", inserts(rows)) and two.batches() == {"a/b", "c", "d", "e"}


def test_token_counts_by_hand(spark, sf_dir):
    count = byte_bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want, seen = defaultdict(lambda: [0, 0]), set()
    import re

    for r in sorted(table(spark, sf_dir, "documents").collect(), key=lambda r: r["doc_id"]):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        if key not in seen:
            seen.add(key)
            want[r["source"], r["lang"]][0] += 1
            want[r["source"], r["lang"]][1] += count(r["text"]) + 1
    got = {(r["source"], r["lang"]): [r["documents"], r["tokens"]] for r in op1_token_counts(spark, sf_dir).collect()}
    assert got == dict(want)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = toxicity.train(docs, labels)
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).where("lang = 'en'")
    rows = toxicity.score_toxicity(held, machine).collect()
    right = [(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]
    assert len(right) > 20 and np.mean(right) > 0.95
    clean, marred = machine.words(["of", "the", "tion", "with"]), machine.words(["stu-pid", "s.t.u.p.i.d", "stuupid", "worthlless"])
    assert marred.min() > machine.middle > clean.max()
    assert toxicity.words_of("s t u p i d thing") >= {"stupid", "thing"}
    odd = spark.createDataFrame([(None, "x"), ("", "y"), ("idiot " * 5000, "z"), ("q" * 100_000, "w")], "text string, score string").withColumnRenamed("score", "other")
    got = {r["other"]: r["score"] for r in toxicity.score_toxicity(odd, machine).collect()}
    assert got["x"] == got["y"] < 0.1 and got["z"] > 0.5 and 0 <= got["w"] <= 1
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.score_toxicity(odd, None).where("score = 0").count() == 4


def test_toxicity_over_all_languages(spark):
    """Held-out rows of sf0.1. Spanish has some 27 toxic texts to learn from there, and no bound of its own; the README has
    its figures."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = toxicity.score_toxicity(held, toxicity.train(docs, labels)).collect()
    flagged = lambda bad, *langs: [r["score"] >= 0.5 for r in rows if (r["toxic"] == 1) == bad and (not langs or r["lang"] in langs)]
    assert np.mean(flagged(True)) > 0.7 and np.mean(flagged(True, "en")) > 0.8 and np.mean(flagged(False)) < 0.03
    assert all(np.mean(flagged(False, x)) < 0.08 for x in ("de", "en", "fr"))


def test_letters_of_all_scripts_are_told_apart():
    rows, _ = toxicity.Letters("abc").rows(["日本語だ", "中国文字", "한국어로"])
    assert len({tuple(r) for r in rows.tolist()}) == 3 and rows.max() < toxicity.CLASSES


def test_sentence_values_are_the_kernel_machines():
    """Word parts summed by sentence give what the kernel with every landmark gives."""
    words = ["idiot", "others", "some", "worthless"]
    reader = toxicity.Letters("abcdefghijklmnopqrstuvwxyz")
    rows, _ = reader.rows(words)
    parts = toxicity.explicit(rows)
    share = np.array([1.0, -0.5, 0.25, 2.0])
    weights = np.zeros(toxicity.CLASSES**3, dtype=np.float32)
    for part, x in zip(parts, share, strict=True):
        weights[list(part)] += x * np.array(list(part.values()))
    scorer = toxicity.Scorer("abcdefghijklmnopqrstuvwxyz", weights, 0.1, 1.0, 0.0)
    text = "some idiot. others worthless some!"
    direct = toxicity._features(toxicity.cut(toxicity.tokens_of(text)), reader, toxicity.spread(parts)) @ share + 0.1
    strength = toxicity.Strength(scorer)
    strength.learn([toxicity.tokens_of(text)])
    assert np.allclose(strength.sentences(toxicity.tokens_of(text))[1], direct, atol=1e-4)


def test_kernel_and_triples_agree():
    reader = toxicity.Letters("abcdefghijklmnopqrstuvwxyz")
    rows, _ = reader.rows(["idiot", "iddiot", "others", "ab", "x" * 40])
    parts = toxicity.explicit(rows)
    direct = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in parts] for a in parts]
    assert np.allclose(toxicity.kernel(rows, toxicity.spread(parts)), direct, atol=1e-5)


def test_languages(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = language_id.page_languages(pages, model).collect()
    assert len(got) == pages.count() and np.mean([r["lang"] == r["declared"] for r in got]) > 0.9
    assert language_id.keep_known_languages(docs, model).count() == docs.count()


def fused_by_hand(rows, n, language_id=language_id):
    """The posterior of each answer, from (declared, suffix, domain, host, evidence) rows; own parts are left out."""
    share = [np.exp(e) / np.exp(e).sum() if e is not None else np.zeros(n) for *_, e in rows]
    out = []
    for i, (declared, suffix, domain, host, evidence) in enumerate(rows):
        of = lambda at, value: sum((share[j] for j, r in enumerate(rows) if j != i and r[at] == value and r[4] is not None), np.zeros(n))
        rest = sum((share[j] for j in range(len(rows)) if j != i), np.zeros(n))
        whole = (rest + language_id.TABLE_LEAN) / (rest.sum() + language_id.TABLE_LEAN * n)
        with_host = sum((share[j] for j, r in enumerate(rows) if j != i and r[2] == domain and r[3] is not None), np.zeros(n))
        near = (with_host + language_id.DOMAIN_LEAN * whole) / (with_host.sum() + language_id.DOMAIN_LEAN)
        own = of(3, host)
        prior = (own + language_id.HOST_LEAN * near) / (own.sum() + language_id.HOST_LEAN) if host is not None and any(r[3] == host and r[4] is not None for r in rows) else whole
        score = np.log(prior) + (evidence if evidence is not None else 0)
        for at, value in ((0, declared), (1, suffix)):
            if value is not None and any(r[at] == value and r[4] is not None for r in rows):
                score = score + np.log((of(at, value) + 0.5) / (rest + 1))
        p = np.exp(score - score.max())
        out.append(p / p.sum())
    return out


def test_fusion_by_brute_force(spark):
    dice = np.random.default_rng(9)
    pick = lambda *x: x[dice.integers(len(x))]
    rows = []
    for _ in range(80):
        host = pick("a.x.de", "b.x.de", "c.y.com", "d.co.uk", None)
        evidence = pick(None, *(-dice.random(3) * 4 for _ in range(5)))
        rows.append((pick("de", "en", None), host and host.rpartition(".")[2], host and ".".join(host.split(".")[1:]), host, None if evidence is None else evidence - evidence.max()))
    table = spark.createDataFrame([(i, *r[:4], None if r[4] is None else r[4].tolist()) for i, r in enumerate(rows)], "i int, declared string, suffix string, domain string, host string, evidence array<double>")
    model = language_id.TextModel(["de", "en"], np.zeros((language_id.BUCKETS, 2)))
    got = {r["i"]: r for r in language_id.fuse(table, model).collect()}
    for i, p in enumerate(fused_by_hand(rows, 3)):
        if rows[i][0] is None and rows[i][3] is None and rows[i][4] is None:
            assert got[i]["lang"] is None and got[i]["rejected"]
        else:
            assert abs(got[i]["posterior"] - p.max()) < 1e-9 and got[i]["lang"] == ["de", "en", None][int(p.argmax())]
            assert got[i]["rejected"] == (p.argmax() == 2 or p.max() < language_id.LEAST)


def test_every_labelled_language_is_learned(spark):
    rows = [(f"l{i:03d}", " ".join(f"w{i}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(40))) for i in range(230)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == sorted(lang for lang, _ in rows)
    assert np.mean([model.languages[min(int(model.likelihoods(t).argmax()), 229)] == lang for lang, t in rows]) > 0.95


def test_text_of_no_learned_language_is_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    odd = spark.createDataFrame([(-1, "Быстрая лиса перепрыгнула через ленивую собаку и убежала в тёмный лес"), (-2, "敏捷的狐狸跳过了懒狗然后跑进了黑暗的森林里面去寻找食物")], "doc_id long, text string")
    some = docs.select("doc_id", "text", "source").unionByName(odd.withColumn("source", F.lit("src0")))
    kept = language_id.keep_known_languages(some, language_id.train(docs))
    assert kept.where("doc_id < 0").isEmpty() and kept.count() == docs.count()


def test_domains(spark):
    urls = spark.createDataFrame([("http://a.b.co.uk/x",), ("https://www.example.com",), ("http://x.gov.in",), ("http://localhost/",), (None,)], "url string")
    assert [r["d"] for r in urls.select(language_id.host_parts("url")[1].alias("d")).collect()] == ["b.co.uk", "example.com", "x.gov.in", None, None]


def test_language_edge_cases(spark):
    model = language_id.train(table(spark, "/root/testdata/sf0.01", "documents"))
    text = "the of and with that this was the of and " * 20
    rows = [(1, None, None), (2, "http://h.example.de/x", "<html lang='de'></html>"), (3, "no address", f"<html><p>{text}"), (None, "https://u@h.example.de:8/", f"<HTML LANG=en><script>der die</script>{text}"), (2, "http://h.example.de/x", "<html lang='de'></html>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    got = sorted(((r["page_id"] or 0), r["lang"], r["rejected"], r["host"], r["declared"]) for r in language_id.page_languages(pages, model).where("page_id is null or page_id <> 1").collect())
    assert [g[0] for g in got] == [0, 2, 2, 3] and got[0][1] == "en" and got[0][3] == "h.example.de" and got[3][1] == "en"
    one = language_id.page_languages(pages.where("page_id = 1"), model).first()
    assert one["lang"] is None and one["rejected"]
    assert language_id.page_languages(pages.limit(0), model).count() == 0
    docs = spark.createDataFrame([(1, text, None, None), (2, None, "en", None), (None, "", None, "s")], "doc_id long, text string, lang string, source string")
    assert sorted((r["doc_id"] or 0) for r in language_id.keep_known_languages(docs, model).collect())[-1] == 1
    empty = language_id.train(docs.limit(0))
    assert language_id.keep_known_languages(docs, empty).count() == 3


def test_language_stage_writes_no_texts(spark):
    """What is written between is small beside the texts; rejected rows go whatever their id and source, repeated ones too."""
    from pathlib import Path

    dice = np.random.default_rng(4)
    words = np.array(["".join(dice.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(20_000)])
    english = [(i, " ".join(dice.choice(words, 400)), "en", "a") for i in range(500)]
    odd = "敏捷的狐狸跳过了懒狗然后跑进了黑暗的森林里面去寻找食物"
    docs = spark.createDataFrame([*english, (1, odd, None, "a"), (1, odd, None, "a"), (None, odd, None, None), (7, None, "en", "a")], "doc_id long, text string, lang string, source string")
    model = language_id.train(docs)
    size = lambda: sum(x.stat().st_size for x in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet"))
    before = size()
    kept = language_id.keep_known_languages(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(500), 7])
    assert size() - before < sum(len(x[1]) for x in english) / 20


def test_languages_of_one_text_are_learned(spark):
    """Many rows of one text, with ids of their own, with one id, and without: each language is learned and stays."""
    from docproof.llm.language_id import keep_known_languages, train

    english = [(i, f"the quick brown fox {i} jumps over the lazy dog and then some more words {i * 7}", "en", "a") for i in range(300)]
    one = [(1000 + i, "zażółć gęślą jaźń wszystkim którzy przyszli dzisiaj na spotkanie", "pl", "b") for i in range(4000)]
    same = [(7, "ystävällinen yhdistys järjestää tänään yhteisen illan kaikille", "fi", "c")] * 4000
    docs = spark.createDataFrame(english + one + same, "doc_id long, text string, lang string, source string")
    for sample in (50, 2000):
        model = train(docs, sample=sample)
        assert model.languages == ["en", "fi", "pl"] and (model.table.max(axis=0) - model.table.min(axis=0) > 1).all()
        assert {tuple(r) for r in keep_known_languages(docs, model).groupBy("lang").count().collect()} == {("en", 300), ("pl", 4000), ("fi", 4000)}
    assert train(docs.drop("doc_id")).languages == ["en", "fi", "pl"]


def test_toxicity_holds_few_words_at_a_time():
    """A batch's words do not stand in memory together, nor does a task's whole vocabulary."""
    import tracemalloc

    from docproof.llm import toxicity

    texts = [" ".join(f"w{(97 * i + j) % 5000}" for j in range(300)) for i in range(2000)]
    strength = toxicity.Strength(toxicity.Scorer("etaoin", np.zeros(toxicity.CLASSES**3, dtype=np.float32), 0.0, 1.0, 0.0))
    strength.of(texts[:200])
    tracemalloc.start()
    values = strength.of(texts[200:1200])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(values) == 1000 and peak < 10_000_000  # some 20 MB where the words of 1000 texts stand together
    assert toxicity.KEEP <= 150_000


def test_pieces_segments_new_parts_of_many_texts_at_once():
    """One call for a slice's unknown parts; spans and texts as one by one, marks in the source included."""
    from docproof.llm import pieces as p

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        ours = p.Pieces(file.read())
    texts = ["one two", "", "a\u2581 b \u2581", "\U0001f600 two\n\nthree \x00", " \u00e9\u0301 ", "x" * 500]
    calls, encode = [], ours.library.encode
    ours.library = type("Counted", (), {"encode": staticmethod(lambda x, **more: calls.append(x) or encode(x, **more))})
    found = list(ours.encode_all(texts))
    assert len(calls) == 1 and not any(len(x) > p.LONG for x in ours.segmented)
    for text, (ids, first, end, decoded) in zip(texts, found, strict=True):
        data = text.encode()
        assert decoded == ours.decode(ids.tolist()) == text.replace(p.MARK, " ") and first[-1] == end[-1] == len(data)
        assert b"".join(data[a:b] for a, b in zip(first, end, strict=True)) == data


def test_toxicity_learns_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number {i}. And more of them.") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: (os.getpid(), texts, toxic))
    pid, texts, toxic = toxicity.train(docs, labels)
    assert pid != os.getpid() and toxic == sorted(toxic, reverse=True) and {x.split()[0] == "vile" for x in texts[: sum(toxic)]} == {True}
