"""Graph search against brute force, archives by round trip, and the pipeline."""

import io
import zipfile

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from docproof.llm import warc
from docproof.llm.common import table
from docproof.llm.graph_search import Graph, nearest


def test_recall_against_brute_force():
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(10, 32))
    x = centres[dice.integers(0, 10, 3000)] + dice.normal(size=(3000, 32)) * 0.7
    ids, _, _ = Graph(x).build().search(x[:200].astype(np.float32), 56)
    near = np.argsort(((x[:200, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, near, strict=True)]) > 0.9


def test_search_over_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    got = nearest(rows, every=50).collect()
    data = rows.collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], dtype=np.float64)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(v) for v in ids[np.lexsort((ids, d))] if v != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(best)), total + 10
    assert hits / total >= 0.9


def nearest_by_hand(rows, every=100, k=10):
    """(query, vec_id) -> distance, in exact fractions of the doubles."""
    from fractions import Fraction

    exact = {i: [Fraction(x) for x in v] for i, v in rows}
    for q in (i for i in exact if i % every == 0):
        near = sorted((sum((a - b) ** 2 for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)
        yield q, [i for _, i in near[:k]]


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 1e5), (1e-30, 0.0), (1e200, 0.0), (3e-310, 0.0), (1e300, 0.0)])
def test_search_of_far_and_tiny_vectors(spark, scale, offset):
    dice = np.random.default_rng(4)
    rows = [(i, (dice.normal(size=3) * scale + offset).tolist()) for i in range(600)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=64).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = [len(set(near) & set(got[q])) / 10 for q, near in nearest_by_hand(rows)]
    assert len(hits) == 6 and all(len(x) == 10 for x in got.values()) and np.mean(hits) >= 0.9
    assert all(np.isfinite(s) and s > 0 for x in got.values() for s in x.values())


def test_search_over_mixed_magnitudes_and_blocks(spark, monkeypatch):
    from docproof.llm import graph_search

    monkeypatch.setattr(graph_search, "QUERY_BLOCK", 7)
    dice = np.random.default_rng(6)
    rows = [(i, (dice.normal(size=8) * 10.0 ** (-150 * (i % 3))).tolist()) for i in range(900)] + [(8, [1.0] * 8), (3, [2.0] * 8), (100, [1e9] * 8)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, shard_rows=64).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(x) == len(set(x)) == 10 for x in got.values()) and len(got) == 45
    first = [(i, v) for i, v in rows if sum(j == i for j, _ in rows) == 1]
    hits = [len(set(near) & set(got[q])) / 10 for q, near in nearest_by_hand(first, 20) if q in got]
    assert np.mean(hits) >= 0.9


def test_a_search_that_reaches_too_few_looks_at_all(spark):
    from docproof.llm.graph_search import build_index, search_index

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 40)], "vec_id long, embedding array<double>")
    lost = build_index(rows).withColumn("near", F.transform("near", lambda _: F.array().cast("array<int>")))
    asked = spark.createDataFrame([(5, [5.0, 1.0])], "id long, v array<double>")
    assert [r["vec_id"] for r in search_index(lost, asked, 4).orderBy("rank").collect()] == [4, 6, 3, 7]


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (100, [2.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (200, [5.0, float("inf")])]
    got = nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")).collect()
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert found == {(0, 1): (7, 1.0), (0, 2): (8, 1.0), (0, 3): (100, 1.0), (100, 1): (7, 0.0), (100, 2): (8, 0.0), (100, 3): (0, 1.0)}
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    same = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = nearest(same).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and {r["score"] for r in got} == {0.0}


@pytest.mark.parametrize("force64", [False, True])
def test_zip_is_a_zip(tmp_path, force64):
    import zlib

    data = {"a.txt": b"hello" * 100, "b/ü.bin": bytes(range(256))}
    out = io.BytesIO()
    writer = warc.ZipWriter(out, force64)
    for name, body in data.items():
        writer.member(name, iter([body[:7], body[7:]]), len(body), zlib.crc32(body))
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as standard:
        assert standard.testzip() is None and {n: standard.read(n) for n in standard.namelist()} == data
    (tmp_path / "x.zip").write_bytes(out.getvalue())
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.zip")) as file:
        for name, (at, size, _) in warc.ZipDirectory(file).members.items():
            file.seek(at)
            assert file.read(size) == data[name]
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr("a", "b" * 100)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "y.zip")) as file, pytest.raises(ValueError, match="not stored"):
        warc.ZipDirectory(file)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (9, "http://b/\r\nX: y", "same"), (5, None, "same"), (2, "http://c/", None), (3, "u", ""), (4, "u", "é\r\n\r\n" * 1000), (None, "u", "lost"), (-7, "u", "neg"), (9, "v", "same"), (6, "u", "x" * 6_000_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha string")
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", archive_records=2)
    assert archives.agg(F.sum("records")).first()[0] == 10
    got = warc.read_archives(archives).collect()
    lone = [r for r in got if r["page_id"] is None]
    assert [(r["record_type"], bytes(r["payload"])) for r in lone] == [("response", b"lost")]
    kind = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] not in (9, None))
    assert kind == [(-7, "response", None, 3), (1, "revisit", 9, 4), (2, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, 6000), (5, "revisit", 9, 4), (6, "response", None, 6_000_000)]
    assert [r["record_type"] for r in got if r["page_id"] == 9] == ["response", "response"]
    assert all(r["payload_digest"] == warc.digest(bytes(r["payload"])) for r in got if r["record_type"] == "response")
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None}[4] == "é\r\n\r\n" * 1000
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def foreign_package(path, payloads, name="rec-0.warc.gz", spoil=b""):
    """A package as other writers make it: own names, records sorted by address in the index, a plain WARC too."""
    import gzip
    import json

    def one(i, body, kind="response"):
        http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-{i:012d}>\r\nWARC-Target-URI: http://x/{i}\r\nWARC-Payload-Digest: sha1:{warc.digest(body)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http.replace(spoil, b"?" * len(spoil)) + b"\r\n\r\n"

    packed, plain, lines = b"", b"", []
    for i, body in enumerate(payloads):
        data = one(i, body)
        place = {"url": f"http://x/{i}", "offset": str(len(plain if i % 3 == 0 else packed)), "filename": "more.warc" if i % 3 == 0 else name}
        data = data if i % 3 == 0 else gzip.compress(data)
        plain, packed = (plain + data, packed) if i % 3 == 0 else (plain, packed + data)
        lines.append(f"x,{9 - i})/ 20200101000000 " + json.dumps(place | {"length": str(len(data))}))
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("datapackage.json", "{}")
        out.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta 0", *sorted(lines)]).encode()))
        out.writestr(f"archive/{name}", packed)
        out.writestr("archive/more.warc", plain)


def test_packages_of_other_writers(spark, tmp_path):
    payloads = [bytes([65 + i]) * (i * 900) for i in range(9)]
    foreign_package(tmp_path / "a.wacz", payloads)
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")).collect()
    assert {(r["url"], bytes(r["payload"]), r["page_id"]) for r in got} == {(f"http://x/{i}", p, None) for i, p in enumerate(payloads)} and len(got) == 9
    assert all(r["record_id"].startswith("<urn:uuid:0000") for r in got)


def test_broken_packages_raise(tmp_path):
    with pytest.raises(ValueError, match="digest"):
        foreign_package(tmp_path / "b.wacz", [b"x", b"spoiled"], spoil=b"oil")
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.wacz")) as file:
            import gzip

            for packed, at, n in warc.records_of(file):
                file.seek(at)
                warc.row_of(gzip.decompress(file.read(n)) if packed else file.read(n))
    foreign_package(tmp_path / "c.wacz", [b"x"])
    data = bytearray((tmp_path / "c.wacz").read_bytes())
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "c.wacz")) as file:
        at = warc.ZipDirectory(file).members["indexes/index.cdx.gz"][0]
    data[at + 12] ^= 1
    (tmp_path / "c.wacz").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "c.wacz")) as file, pytest.raises(ValueError, match="CRC"):
        warc.records_of(file)


def test_archives_query_by_brute_force(spark, sf_dir):
    from docproof.llm.queries import op9_warc

    pages = table(spark, sf_dir, "pages").select("page_id", "html").collect()
    last = {}
    for r in pages:
        last[r["html"] or ""] = max(r["page_id"], last.get(r["html"] or "", r["page_id"]))
    want = {(r["page_id"], len((h := r["html"] or "").encode()), warc.digest(h.encode()), "response" if last[h] == r["page_id"] else "revisit", None if last[h] == r["page_id"] else last[h]) for r in pages}
    assert {tuple(r) for r in op9_warc(spark, sf_dir).collect()} == want and len(want) == len(pages)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    odd = spark.createDataFrame([(-1, None, None, None, None), (None, "some words of the text and that", "en", "src0", 3), (-3, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("kept", F.lit("clash")).withColumn("label", F.lit(None).cast("string"))
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == [*columns, "kept", "label"], name
        assert after.count() <= docs.count() and after.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = p.run(spark, sf_dir)
    assert last.count() > 0 and last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
