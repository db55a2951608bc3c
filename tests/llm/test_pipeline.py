"""The pipeline, stage by stage, against plain versions of what each stage does."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keyspan.llm import secret_scan
from keyspan.llm.queries import WORD_TOKENIZER

from .conftest import edge_rows
from .test_sets import plain_classes
from .test_texts import plain_measures

STAGES = dict(corpus_pipeline.STAGES)


def held(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def plain_cleaned(docs):
    first, words = {}, {i: t.encode().split() for i, t in docs.items()}
    for i, ws in words.items():
        for k in range(len(ws) - 12):
            key = tuple(ws[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, ws in words.items():
        gone = [False] * len(ws)
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        if not gone or not all(gone):
            out[i] = [w.decode() for w, g in zip(ws, gone) if not g]
    return out


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = STAGES["quality"](spark, docs, sf).cache()
    limits = {i for i, t in held(docs).items() if (m := plain_measures(t or ""))[0] < 10 or 100 * m[4] > 20 * m[0]}
    kept = held(good)
    assert kept and not set(kept) & limits and set(kept) <= set(held(docs)) and good.columns == docs.columns

    alone = STAGES["near_copies"](spark, good, sf).cache()
    assert alone.columns == docs.columns and set(held(alone)) == {i for i, (_, c) in plain_classes(list(kept.items()), 5, 80).items() if c == i}

    single = STAGES["passages"](spark, alone, sf).cache()
    want = plain_cleaned(held(alone))
    assert single.columns == docs.columns and {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in held(single).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in single.collect() if r["text"] != held(alone)[r["doc_id"]])

    clean = STAGES["secrets"](spark, single, sf).cache()
    field = secret_scan.trained_field(single)
    assert held(clean) == {i: secret_scan.redacted_text(t, secret_scan.all_spans(t, field)[1]) for i, t in held(single).items()}
    assert not any(secret_scan.base_spans(t) for t in held(clean).values())

    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = lambda df: sorted(tuple(r[c] for c in key) for r in df.collect())
    last = STAGES["packing"](spark, clean, sf)
    totals = {r[0]: r[4] for r in rows(last)}
    tokens = Tokenizer.from_file(WORD_TOKENIZER)
    for i, t in held(clean).items():
        assert totals[i] == len(tokens.encode(t, add_special_tokens=False).ids) + 1
    ran = corpus_pipeline.run(spark, sf)
    assert ran.count() >= len(totals) and {r["doc_id"] for r in ran.collect()} == set(totals)


CLASHING = ["1 as changed_id", "'x' as new_text", "2 as doc", "3 as block", "'y' as node", "4 as id", "'z' as old_text", "6 as _salt", "'s' as spans"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_cases(spark, sf, edge, none, name):
    """Nulls, blanks, ties, repeated rows, long texts, an empty table, and columns whose names the stages also use."""
    odd = edge.selectExpr("*", *CLASHING)
    out = STAGES[name](spark, odd, sf)
    rows = out.collect()
    assert STAGES[name](spark, none, sf).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {i for i, _ in edge_rows()}
        return
    assert out.columns == odd.columns and all((r["changed_id"], r["node"], r["_salt"]) == (1, "y", 6) for r in rows)
    left, before = Counter((r["doc_id"], r["text"]) for r in rows), Counter(edge_rows())
    texts = dict(edge_rows())
    if name == "quality":
        measures = {t: plain_measures(t or "") for _, t in before}
        assert not any(measures[t][0] < 10 or 100 * measures[t][4] > 20 * measures[t][0] for _, t in left) and not left - before
    if name == "near_copies":
        # 0 stands for 1, 2 and the null id's equal text; 6 and 7 alone, 7 stands for 15; one of the equal rows 11; blanks stay, each row once
        gone = {(1, texts[1]), (2, texts[2]), (None, texts[0]), (15, texts[15]), (9, texts[9])}
        assert left == Counter({row: 1 for row in before if row not in gone})
    if name == "passages":
        assert left[3, None] == left[4, ""] == left[6, "one"] == 1 and left[0, texts[0]] == 1 and left[11, texts[11]] == 2 and left[None, texts[0]] == 1
        assert not any(i == 1 for i, _ in left) and left[12, "start end"] == 1 and left[9, "tail"] == 1  # all of 1 is in 0, and these hold the rest
    if name == "secrets":
        assert left == before


def test_rows_that_share_an_id_keep_their_texts(spark, sf):
    words = [f"w{k}" for k in range(40)]
    passage = " ".join(words)
    rows = [(1, passage), (5, f"before {passage}"), (5, "an entirely different text, with enough words to stand for itself"), (6, "x " * 3 + passage + " y"), (5, f"before {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    assert Counter((r["doc_id"], r["text"]) for r in STAGES["passages"](spark, df, sf).collect()) == Counter([rows[0], (5, "before"), rows[2], (6, "x x x y"), (5, "before")])
    near = [(1, passage), (5, passage + " more"), rows[2], rows[2], (None, passage), (None, "other words"), (None, "other words")]
    df = spark.createDataFrame(near, "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    assert Counter((r["doc_id"], r["text"]) for r in STAGES["near_copies"](spark, df, sf).collect()) == Counter([near[0], rows[2], (None, "other words")])
