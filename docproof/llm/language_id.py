"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language meet in one posterior:

* the text's own likelihood under a character model of each language (byte triples, hashed to ``BUCKETS``), learned from
  a bounded sample of labelled documents, ``SAMPLE_DOCS`` of each language; none of them is an answer too (the last one),
  under which all triples are alike;
* the language that the markup declares, as reliable as declarations are in this corpus;
* the suffix of the address (country or generic), likewise;
* the host's habit: its languages' shares, smoothed towards its domain's, and those towards the whole corpus'.

The last three are estimated by grouped aggregation over all rows from what the texts alone say, summed as probabilities;
a row's own part is taken out of every sum before the sum speaks about it, so no text counts twice. The likelihood of a
text is tempered (``TEMPER``, ``FULL``), since neighbouring triples repeat each other's evidence.

The model holds 256 KB a language, on the driver and in each worker; every language that a label names is learned.
Hosts join back from a written table, so that adaptive execution can split a host with a third of the pages.

Defined results: null, empty and letterless texts have no text evidence and rest on the other kinds; without any
evidence at all the language is null and the row is rejected, as is a row that none of the languages explains; null
addresses and declarations are their own (uninformative) kinds; repeated rows count each; without labelled rows there are
no languages, every language is null and nothing is rejected, since nothing can be told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain, save

BUCKETS = 1 << 15
SAMPLE_DOCS = 2_000
#: Rows draw a number below this one, from their hash.
DRAW = 1 << 53
#: Each triple counts by half, and all of a text's together like ``FULL`` of them at most.
TEMPER, FULL = 0.5, 60.0
#: Pseudo-rows with which a host's shares lean on its domain's, and a domain's on the corpus'.
HOST_LEAN, DOMAIN_LEAN, TABLE_LEAN = 20.0, 50.0, 1.0
LEAST = 0.5
#: Second labels under which two-letter suffixes hand out domains.
SECOND = "ac|co|com|edu|go|gob|gouv|gov|ne|net|nom|or|org"


def _grams(text: str) -> np.ndarray:
    """The hashed byte triples of the text's lower-cased letters and the single spaces between its words."""
    codes = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    keep = letter.copy()
    keep[:-1] |= letter[1:] & ~letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
    if not letter.any() or len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = codes[:-2] * 65_599 + codes[1:-1] * 257 + codes[2:]
    return (((mixed * np.uint32(2_654_435_761)) >> 15) & (BUCKETS - 1)).astype(np.int64)


class TextModel:
    """log P(triple | language), a column for each language; the answers are the languages and none of them."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table

    def likelihoods(self, text: str) -> np.ndarray | None:
        """The tempered log likelihoods of the answers, the greatest at 0; None without evidence."""
        grams = _grams(text)
        if not len(grams) or not self.languages:
            return None
        counts = np.bincount(grams, minlength=BUCKETS)
        at = np.nonzero(counts)[0]
        total = np.append(counts[at] @ self.table[at], -np.log(BUCKETS) * len(grams)) * min(TEMPER, FULL / len(grams))
        return total - total.max()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE_DOCS, id_col: str = "doc_id") -> TextModel:
    """Learns from about ``sample`` labelled rows of each language, chosen by a hash of id and text; the row with a
    language's smallest hash is always among them, so that no language goes unlearned, and rows equal in both count once.
    The counts come to the driver: their number is bounded by languages times buckets."""
    key = [F.col(id_col).cast("string")] if id_col in docs.columns else []
    rows = docs.select(F.col(lang_col).alias("lang"), plain(text_col).alias("text"), F.pmod(F.xxhash64(*key, plain(text_col), F.lit("language")), F.lit(DRAW)).alias("draw")).where("lang is not null")
    counted = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("draw").alias("least")).toPandas().sort_values("lang", ignore_index=True)
    languages = counted["lang"].tolist()
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    limits = [(lang, max(int(least), int(min(1.0, sample / n) * DRAW))) for lang, n, least in counted[["lang", "count", "least"]].itertuples(index=False)]
    taken = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, taken long"))
    chosen = rows.join(taken, "lang").where(F.col("draw") <= F.col("taken")).dropDuplicates(["lang", "draw"]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                totals[lang] = totals.get(lang, 0) + np.bincount(_grams(text), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "gram": at, "n": total[at]})

    found = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table, place = np.full((BUCKETS, len(languages)), 0.5), {x: i for i, x in enumerate(languages)}
    table[found["gram"].to_numpy(dtype=np.int64), found["lang"].map(place).to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.float64)
    return TextModel(languages, np.log(table / table.sum(axis=0)))


def text_evidence(rows: DataFrame, model: TextModel, text: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the text's log likelihood of each answer, null without evidence."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        model = held.value
        return pa.array([model.likelihoods(x) for x in texts.to_pylist()], type=pa.list_(pa.float64()))

    return rows.withColumn(name, run(plain(text)))


def host_parts(url: str) -> tuple[F.Column, F.Column, F.Column]:
    """(host, domain, suffix) of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    domain = F.regexp_extract(host, rf"([^.]+\.(?:(?:{SECOND})\.[a-z]{{2}}|[^.]+))$", 1)
    return host, F.nullif(domain, F.lit("")), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_language(html: str) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def visible_text(html: str) -> F.Column:
    bare = F.regexp_replace(plain(html), r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[#A-Za-z0-9]{1,10};", " ")


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` has declared, suffix, domain, host (strings, or null) and evidence; it comes back with lang, posterior and
    rejected added. It is read several times and should be a written table."""
    if not model.languages:
        return rows.withColumn("lang", F.lit(None).cast("string")).withColumn("posterior", F.lit(None).cast("double")).withColumn("rejected", F.lit(False))
    n = len(model.languages) + 1
    weights = F.transform("evidence", lambda x: F.exp(x))
    share = F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))
    told = rows.where("evidence is not null").withColumn("p", share)
    sums = lambda df, p, name, *keys: df.groupBy(*keys).agg(F.array(*[F.sum(F.get(p, F.lit(i))) for i in range(n)]).alias(name))
    total = _total(sums(told, "p", "n"), n)
    array = lambda values: F.array(*[F.lit(float(x)) for x in values])
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    values = {kind: save(sums(told.where(F.col(kind).isNotNull()), "p", f"__{kind}", kind), kind) for kind in ("declared", "suffix")}
    hosts = sums(told.where("host is not null"), "p", "__host", "domain", "host")
    domains = sums(hosts, "__host", "__domain", "domain").withColumnRenamed("domain", "of")
    hosts = save(hosts.join(domains, F.col("domain").eqNullSafe(F.col("of"))).select("host", "__host", "__domain"), "hosts")

    out = rows.join(values["declared"], "declared", "left").join(values["suffix"], "suffix", "left").join(hosts, "host", "left")
    out = out.withColumn("__own", F.coalesce(share, array([0.0] * n)))
    rest = lambda a: F.zip_with(a, "__own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    lean = lambda a, to, by: F.zip_with(a, to, lambda x, y: (x + by * y) / (size(a) + by))
    out = out.withColumn("__all", rest(array(total))).withColumn("__whole", lean("__all", array([1 / n] * n), TABLE_LEAN * n))
    for part in ("__declared", "__suffix", "__host", "__domain"):
        out = out.withColumn(part, rest(F.col(part)))
    out = out.withColumn("__domain", lean("__domain", "__whole", DOMAIN_LEAN)).withColumn("__prior", F.coalesce(lean("__host", "__domain", HOST_LEAN), "__whole"))
    score = F.transform("__prior", lambda x: F.log(x))
    for part in ("__declared", "__suffix"):  # how often this value comes with each answer, up to what all share
        rate = F.zip_with(part, "__all", lambda x, y: F.log((x + F.lit(0.5)) / (y + F.lit(1.0))))
        score = F.zip_with(score, F.coalesce(rate, array([0.0] * n)), lambda x, y: x + y)
    score = F.zip_with(score, F.coalesce("evidence", array([0.0] * n)), lambda x, y: x + y)
    out = out.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    posterior = 1 / size(F.transform("__score", lambda x: F.exp(x - F.col("__top"))))
    best = F.get(F.array(*[F.lit(x) for x in model.languages]), F.array_position("__score", F.col("__top")).cast("int") - 1)
    known = F.col("evidence").isNotNull() | F.col("declared").isNotNull() | F.col("host").isNotNull()
    out = out.withColumn("lang", F.when(known, best)).withColumn("posterior", F.when(known, posterior))
    return out.withColumn("rejected", F.col("lang").isNull() | (F.col("posterior") < LEAST)).select(*rows.columns, "lang", "posterior", "rejected")


def _total(sums: DataFrame, n: int) -> np.ndarray:
    row = sums.first()
    return np.array([x or 0.0 for x in row["n"]]) if row else np.zeros(n)


def page_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, lang, posterior, rejected, declared, host."""
    host, domain, suffix = host_parts(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared_language(html_col).alias("declared"), visible_text(html_col).alias("text"))
    rows = save(text_evidence(rows, model, "text", "evidence").drop("text"), "evidence")
    return fuse(rows, model).select("page_id", "lang", "posterior", "rejected", "declared", "host")


def keep_known_languages(docs: DataFrame, model: TextModel, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the rows whose language is rejected. The source stands for the host; there
    is no markup and no address, so rows of one text and source fare alike. What is written between holds a text's hash in
    its place; texts stay where they are."""
    source, place = docs[f"`{source_col}`"].cast("string"), F.xxhash64(plain(docs[f"`{text_col}`"]))
    nothing = [F.lit(None).cast("string").alias(x) for x in ("domain", "suffix", "declared")]
    rows = docs.select(source.alias("host"), *nothing, plain(docs[f"`{text_col}`"]).alias("text"), place.alias("place"))
    rows = save(text_evidence(rows, model, "text", "evidence").drop("text"), "evidence")
    gone = save(fuse(rows, model).where("rejected").select("host", "place").distinct(), "rejected")
    gone = gone.select(F.col("host").alias("__gone_host"), F.col("place").alias("__gone_place"))
    return docs.join(gone, source.eqNullSafe(gone["__gone_host"]) & (place == gone["__gone_place"]), "left_anti")
