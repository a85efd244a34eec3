"""Routing by hand: each decision of a document's way, and that the given tables take every one."""

import pytest
from pyspark.sql import functions as F

from docproof.operators import routing
from docproof.plans.decisions import routed
from docproof.sources.tables import load

NEEDS = "doc_id long, declared_type string, code_source string, text_type string, type_hint string, usual_type string, pages int, parent_id long, is_digital boolean, local_groups int, triage struct<document_type: string, languages: array<string>, handwriting_present: boolean, groups: int>, quality_bucket string, unreadable_pages int, indic_text boolean, observed_type string, languages array<string>, handwriting boolean, legibility string, targets int"
NAMES = [x.split()[0] for x in NEEDS.replace("struct<document_type: string, languages: array<string>, handwriting_present: boolean, groups: int>", "x").split(", ")]


def way(spark, **facts):
    base = dict.fromkeys(NAMES) | {"doc_id": 1, "pages": 1, "unreadable_pages": 0, "legibility": "clear", "targets": 0} | facts
    return routing.after_reading(routing.before_reading(spark.createDataFrame([tuple(base[x] for x in NAMES)], NEEDS))).first().asDict()


def look(kind=None, languages=(), hand=None, groups=None):
    return (kind, list(languages), hand, groups)


CASES = [
    ({"declared_type": "po", "code_source": "einvoice_qr"}, {"free_type": "po", "needs_triage": False}),
    ({"declared_type": "memo", "code_source": "einvoice_qr", "text_type": "lr"}, {"free_type": "invoice"}),
    ({"text_type": "grn", "type_hint": "po"}, {"free_type": "grn"}),
    ({"type_hint": "po"}, {"free_type": "po", "readings": 1, "zooms": 0}),
    ({"type_hint": "letter", "usual_type": "lr"}, {"free_type": None, "guessed": "lr", "needs_triage": False, "hard": True, "model": "complex", "effort": "high"}),
    ({"usual_type": "lr", "pages": 2}, {"guessed": None, "needs_triage": True, "doc_type": "invoice"}),
    ({"pages": 9, "text_type": "invoice"}, {"needs_triage": True, "parts": 1}),
    ({"pages": 4, "text_type": "invoice", "is_digital": True}, {"needs_triage": False}),
    ({"pages": 5, "text_type": "invoice", "is_digital": True}, {"needs_triage": True}),
    ({"pages": 5, "text_type": "invoice", "is_digital": True, "local_groups": 2}, {"needs_triage": False, "outcome": "split", "parts": 2, "readings": 0}),
    ({"pages": 5, "text_type": "invoice", "is_digital": True, "local_groups": 2, "parent_id": 7}, {"outcome": "read", "parts": 1}),
    ({"pages": 5, "is_digital": True, "local_groups": 2, "triage": look("po", groups=1)}, {"outcome": "read", "parts": 1, "doc_type": "po"}),
    ({"pages": 30, "triage": look("contract", ["english", "hindi"], groups=1)}, {"doc_type": "contract", "pages_read": 30, "hard": True}),
    ({"pages": 30, "text_type": "invoice", "triage": look("po", ["other"], groups=1)}, {"doc_type": "invoice", "pages_read": 12, "hard": False, "model": "clean"}),
    ({"pages": 1, "text_type": "invoice", "triage": look("po", ["tamil"], True, 3)}, {"hard": False, "outcome": "read"}),
    ({"triage": look("letter")}, {"outcome": "needs_human", "final_type": None, "readings": 0}),
    ({"text_type": "invoice", "unreadable_pages": 1}, {"outcome": "unreadable", "readings": 0}),
    ({"text_type": "invoice", "quality_bucket": "poor_scan"}, {"hard": True, "edge": 2576}),
    ({"text_type": "invoice", "quality_bucket": "digital"}, {"hard": False, "edge": 1800}),
    ({"text_type": "invoice", "quality_bucket": "good_scan", "indic_text": True}, {"hard": True, "edge": 2200}),
    ({"text_type": "invoice", "observed_type": "po", "targets": 3}, {"final_type": "po", "readings": 2, "zooms": 1, "remark": None}),
    ({"text_type": "invoice", "observed_type": "letter", "targets": 3}, {"outcome": "needs_human", "final_type": None, "zooms": 0, "readings": 1}),
    ({"declared_type": "invoice", "observed_type": "po"}, {"final_type": "invoice", "readings": 1, "remark": "uploaded as invoice, looks like po"}),
    ({"declared_type": "invoice", "observed_type": "letter"}, {"final_type": "invoice", "remark": "uploaded as invoice, looks like something else"}),
    ({"text_type": "invoice", "legibility": "illegible"}, {"outcome": "unreadable", "readings": 1}),
    ({"text_type": "invoice", "languages": ["english", "hindi"]}, {"hard": False, "hard_after": True}),
]


@pytest.mark.parametrize("facts,expected", CASES)
def test_ways(spark, facts, expected):
    got = way(spark, **facts)
    assert {k: got[k] for k in expected} == expected


def test_usual_type(spark):
    rows = [(i, 1, "po" if i < 30 else "invoice", i) for i in range(200)] + [(i, 1, "lr", i - 500) for i in range(300, 400)]
    rows += [(1000 + i, 2, "po", i) for i in range(19)] + [(2000 + i, 3, "memo", i) for i in range(50)] + [(3000 + i, 4, "po" if i % 10 else None, i) for i in range(40)]
    rows += [(4000 + i, 5, "po" if i < 17 else "lr", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, tenant_id long, doc_type string, created_at long")
    assert {tuple(r) for r in routing.usual_type(docs).collect()} == {(1, "invoice", 200, 170), (4, "po", 36, 36), (5, "po", 20, 17)}


def test_given_tables_take_every_way(spark, sf_dir):
    rows = routed(load(spark, sf_dir, "intake")).cache()
    for column, values in {"outcome": {"split", "needs_human", "unreadable", "read"}, "model": {"clean", "complex"}, "edge": {1800, 2200, 2576}, "readings": {0, 1, 2}, "zooms": {0, 1}, "needs_triage": {True, False}}.items():
        assert {r[0] for r in rows.select(column).distinct().collect()} == values, column
    assert rows.where("guessed is not null").count() and rows.where("remark is not null").count() and rows.agg(F.count_distinct("free_type")).first()[0] == 4
    rows.unpersist()
