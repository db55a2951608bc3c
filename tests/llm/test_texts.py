"""Operators that look at one text at a time, against plain versions."""

import base64
import collections
import hashlib
import html as html_module
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyspan.llm import byte_bpe, html_text, packing, quality, queries, secret_scan

from .conftest import edge_rows


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def by_rows(df, key="doc_id"):
    return collections.Counter(tuple(r) for r in df.collect())


# HTML


def page(body, tail=True):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}" + ("</body></html>" if tail else "")


@pytest.mark.parametrize("body, text", [
    ('<nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A title</h1><p>Some&nbsp;text &amp; more</p><p>Second.</p></article><footer>&copy; x</footer>', "A title\nSome text & more\nSecond."),
    ("<article><p><b>Bold lead.<br><p>Next one</p></article><aside>Side</aside>", "Bold lead.\nNext one"),
    ('<div class="wrap"><div class="content"><h1>T</h1><p>Long enough text of the page itself, yes.</p><ul><li>a</li><li>b</li></ul></div><div class="sidebar"><p>Links</p></div><div id="comments"><p>A reader says a lot, far more than the page itself does, and on and on.</p></div></div>', "T\nLong enough text of the page itself, yes.\na\nb"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Text</p><form>mail<input></form></main>", "Text"),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<article><p>cut &am</p><p>off", "cut &am\noff"),
    ("<article><p title=\"a > b\">one<!-- no <p> --> two</p><table><tr><td>c1</td><td>c2</td></tr></table></article>", "one two\nc1\nc2"),
    ("<p>only</p>", "only"), ("", ""),
    ('<div class="layout has-sidebar"><div class="entry-header"><h1>T</h1></div><p>One.</p><div class="reader-comments">no</div></div>', "T\nOne."),
    ('<div class="widget"><p>All of it is in here.</p><nav>menu</nav></div>', "All of it is in here."),
])
def test_main_text(body, text):
    assert html_text.main_text(page(body)) == text
    assert html_text.main_text(page(body, tail=False)) == text


def test_html_of_all_pages_is_the_article(spark, sf):
    got = {r["page_id"]: r for r in queries.op1_html_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = r["html"][r["html"].index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


LINKS = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(8))
PARAGRAPH = "The main text of this page goes on for a while, with words enough to be told from what stands around it. "


@pytest.mark.parametrize("page, text", [
    # no element or name tells what is what
    (f"<div><ul>{LINKS}</ul></div><div><h2>Title</h2><div>{PARAGRAPH * 3}</div><div>Short.</div><div>{PARAGRAPH * 2}</div></div><div><a href='/a'>Imprint</a> <a href='/b'>Contact</a></div>",
     "\n".join(["Title", (PARAGRAPH * 3).strip(), "Short.", (PARAGRAPH * 2).strip()])),
    (f"<table><tr><td><ul>{LINKS}</ul></td><td><div>{PARAGRAPH * 2}</div><div>{PARAGRAPH}</div></td></tr></table>", f"{(PARAGRAPH * 2).strip()}\n{PARAGRAPH.strip()}"),
    # a form around the page; elements that nothing closes; a title in a page's header
    (f"<form action='/'><input><select><option>One</option></select><div>{PARAGRAPH * 2}</div><div>{PARAGRAPH}</div></form>", f"{(PARAGRAPH * 2).strip()}\n{PARAGRAPH.strip()}"),
    (f"<div>{PARAGRAPH}</div><select><div>{PARAGRAPH * 2}</div><object><svg><p>{PARAGRAPH}</p>", f"{PARAGRAPH.strip()}\n{(PARAGRAPH * 2).strip()}\n{PARAGRAPH.strip()}"),
    (f"<header><a href='/'>Site</a><h1>Its title</h1></header><div><p>{PARAGRAPH * 2}</p><p>{PARAGRAPH}</p></div>", f"Its title\n{(PARAGRAPH * 2).strip()}\n{PARAGRAPH.strip()}"),
])
def test_density_finds_the_text_without_names(page, text, monkeypatch):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text
    monkeypatch.setattr(html_text, "kept_nodes", lambda root: (html_text.measure(root) and {0}, set()))
    whole = html_text.main_text(f"<html><body>{page}</body></html>")
    assert "number 3" not in page or "number 3" in whole  # what density leaves out


def test_density_alone_finds_most_articles(monkeypatch):
    """Without the lists of names and elements; keeping the whole tree then never gives the article."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    articles = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "LEFT_OUT", frozenset(["head"]))
    monkeypatch.setattr(html_text, "NOISE", re.compile("(?!)"))
    assert sum(html_text.main_text(p) == a for p, a in zip(pages, articles)) >= 0.9 * len(pages)
    monkeypatch.setattr(html_text, "kept_nodes", lambda root: (html_text.measure(root) and {0}, set()))
    assert not any(html_text.main_text(p) == a for p, a in zip(pages, articles))


@pytest.mark.parametrize("open_, close", [("<b>", "</i>"), ("<div>", "</i>"), ("<div>", "<li></li>"), ("<b>", "<hr>"), ("<table>", "</td>"), ("<svg>", "")])
def test_pages_are_read_in_linear_time(open_, close):
    import time

    took = []
    for n in (2500, 20000):
        began = time.process_time()
        html_text.parsed("x" + open_ * n + close * n)
        took.append(time.process_time() - began)
    assert took[1] < max(30 * took[0], 0.5)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<" * 50), (2, "u", "<" * 50), (3, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = html_text.extracted(pages).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"] for r in got}[3] == "deep"
    assert html_text.extracted(pages.where("false")).count() == 0


# Secrets


def test_base_spans_follow_their_definition(spark, sf):
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, sf).collect()}
    assign = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        row = got[r["doc_id"]]
        assert row["base_sha256"] == sha(",".join(listed))
        assert set(listed) <= set(filter(None, row["spans"].split(",")))
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Secrets that no fixed pattern finds: what stands before them, their letters and their length.
PLANTED = {
    "bearer": ("Authorization: Bearer ", LETTERS + DIGITS, 32), "ghp": ("", LETTERS + DIGITS, 36), "sk": ("", LETTERS + DIGITS, 24), "glpat": ("", LETTERS + DIGITS + "-_", 20), "AIza": ("", LETTERS + DIGITS + "-_", 35),
    "hf": ("", LETTERS, 34), "line": ("", LETTERS + DIGITS + "+/", 64), "is": ("password is ", LETTERS + DIGITS, 16), "far": ("the password for this account is ", LETTERS + DIGITS + "!#%", 16), "letters": ("", LETTERS, 24), "base64": ("", LETTERS + DIGITS + "+/", 43),
}
STARTS = {"ghp": "ghp_", "sk": "sk_live_", "glpat": "glpat-", "AIza": "AIza", "hf": "hf_"}


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.trained_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_finds_secrets_that_the_patterns_miss(spark, field):
    """Planted in texts that the field has not seen; and clean texts stay as they are."""
    random = np.random.default_rng(3)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[6000:8000]]
    for kind, (before, letters, size) in PLANTED.items():
        planted, places = [], []
        for k in random.integers(0, len(texts), 100).tolist():
            words = [m.start() for m in re.finditer(r"[^ \t\n\v\f\r]+", texts[k])] or [0]
            at = int(random.choice(words))
            value = STARTS.get(kind, "") + "".join(random.choice(list(letters), size))
            planted.append(f"{texts[k][:at]}{before}{value} {texts[k][at:]}")
            places.append((at + len(before), at + len(before) + len(value)))
            assert not any(a < places[-1][1] and b > places[-1][0] for a, _, b in secret_scan.base_spans(planted[-1])) or kind == "line"
        found = secret_scan.scan(pa.array(planted, pa.string()), field)
        caught = sum(any(a <= start + 1 and b >= end - 3 for a, _, b in spans) for (_, spans), (start, end) in zip(found, places))
        assert caught >= 90, (kind, caught)
    clean = [(base, spans) for base, spans in secret_scan.scan(pa.array(texts, pa.string()), field) if not base]
    assert sum(spans == [] for _, spans in clean) >= 0.99 * len(clean)
    for plain in ("A sentence in 2024 with 3 numbers, 1,000 of them.", "no numbers at all", "write to anna.smith@example.org or see https://www.example.org/some/page-2024.html",
                  "The password must contain at least eight characters; the token of appreciation is a secret recipe."):
        assert secret_scan.all_spans(plain, field)[1] == []


def test_tags_are_those_of_plain_viterbi(spark, field):
    """Decoding by parts against Viterbi over whole texts, also with weights under which little is surely outside."""
    random = np.random.default_rng(4)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()[:60]] + ["", "token = abcDEF123456xyz and ghp_" + "aB3" * 12]
    tagged = 0
    for scale in (1, 0.05, 0.05, 0.05, 0.05):
        noisy = secret_scan.Field(field.weights * scale + random.normal(0, 0.05 if scale == 1 else 0.5, field.weights.shape), field.moves + np.where(field.moves < -10, 0, random.normal(0, 0.5, (3, 3))), field.shapes)
        tokens = secret_scan.Tokens(noisy.shapes, pa.array(texts, pa.string()))
        got, e, m = noisy.tags(tokens), noisy.emissions(tokens).astype(float), noisy.moves
        score = lambda e, path: m[0, path[0]] + m[path[-1], 0] + e[range(len(path)), path].sum() + sum(m[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        for start, end in zip(tokens.starts.tolist(), tokens.ends.tolist()):
            if start < end:
                best = secret_scan.best_paths(e[None, start:end], m)[0]
                assert abs(score(e[start:end], best.tolist()) - score(e[start:end], got[start:end].tolist())) < 1e-3
        tagged += int((got != 0).sum())
    assert tagged > 100


def test_unicode_letters_do_not_match_keywords_and_failed_matches_are_consumed():
    assert secret_scan.base_spans("paſſword=abcdefghijklmnop") == []
    assert secret_scan.base_spans("PassWord = 'abcdefghijkl'") == [(0, 0, 24)]
    assert secret_scan.base_spans("password=secret: abcdefghijklmno") == []
    assert secret_scan.base_spans("AKIA" + "B" * 13) == [] and secret_scan.base_spans("AKIA" + "B" * 14) == [(0, 1, 18)]
    assert secret_scan.redacted_text("a token=" + "1" * 20 + " b", secret_scan.base_spans("a token=" + "1" * 20 + " b")) == "a [SECRET] b"


def test_secret_edges(spark, edge, none):
    clashing = edge.selectExpr("*", "1 as n_assign", "'x' as spans", "2 as base_sha256", "3 as n_tagged", "4 as row")
    got = secret_scan.scanned(clashing).collect()
    assert len(got) == len(edge_rows()) and sum(r["doc_id"] is None for r in got) == 2
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (0, 0, 0, "") for r in got if r["doc_id"] in (3, 4, 5))
    assert secret_scan.scanned(none).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "token=" + "a1" * 10)], "doc_id long, text string")
    assert secret_scan.scanned(long).first()["spans"] == f"assign:{5 * 300_000}:{5 * 300_000 + 26},hex:{5 * 300_000 + 6}:{5 * 300_000 + 26}"
    kept = secret_scan.redacted(edge)
    assert kept.columns == edge.columns and kept.count() == len(edge_rows())
    assert secret_scan.redacted(none).count() == 0


# Quality


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_measures(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert quality.measures((r["text"] or "").encode())[:5] == plain_measures(r["text"] or "")
    for _, text in edge_rows():
        assert quality.measures((text or "").encode())[:5] == plain_measures(text or "")


def test_forest_finds_bad_documents_and_spares_good_ones(spark):
    got = queries.op5_quality_rules(spark, "/root/testdata/sf0.1").select("doc_id", "kept", "base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    shares = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in shares}
    assert share[1] > 0.99 and share[0] < 0.2


def test_quality_query_against_plain_rules_and_walks(spark, sf):
    """All columns: the measures from plain definitions, the verdict by walking each tree for each document."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest, threshold = quality.fitted(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rejected = 0
    for r in queries.op5_quality_rules(spark, sf).collect():
        text = texts[r["doc_id"]]
        n, chars, symbols, lines, repeats = plain_measures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        x, total = quality.features(np.array([quality.measures(text.encode())], float))[0], 0.0
        for feature, cut, left, path in forest.trees:
            at = 0
            while feature[at] >= 0 and path[at] is not None:
                at = int(left[at]) + int(x[feature[at]] > cut[at])
            total += path[at]
        score = 2.0 ** (-total / len(forest.trees) / forest.expected)
        assert r["kept"] == (not r["base_failed"] and score < threshold)
        rejected += not r["kept"] and not r["base_failed"]
    assert rejected


def test_forest_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "kept", "base_failed")
    shares = got.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in shares}
    assert share[1] > 0.98 and share[0] < 0.2


def test_repeated_labelled_rows_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.fitted(docs, labels)[1] == quality.fitted(docs.union(docs).union(docs), labels)[1]


def test_forest_and_threshold_count_every_labelled_row(spark):
    """The leaves' paths and the threshold from plain counts over all labelled documents, more than any former sample."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(docs.selectExpr("doc_id + 1000000", "concat('More ', text)"))
    labels = labels.select("doc_id", "quality").union(labels.selectExpr("doc_id + 1000000", "quality"))
    forest, threshold = quality.fitted(docs, labels)
    least = {r["doc_id"]: r["q"] for r in labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    found = {(r["doc_id"], quality.measures((r["text"] or "").encode())) for r in docs.where("doc_id is not null").collect() if r["doc_id"] in least}
    found = [(m, least[i] > 0) for i, m in found if not quality.failed(m[0], m[4])]
    x, good = quality.features(np.array([m for m, _ in found], float)), np.array([g for _, g in found])
    assert len(x) > 4000
    for feature, cut, left, path in forest.trees[:5]:
        at, depth = np.zeros(len(x), int), np.zeros(len(x), int)
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            depth += inner
            at = np.where(inner, left[at] + (x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]), at)
        for node in np.unique(at[good]):
            n = (at[good] == node).sum()
            assert path[node] == pytest.approx(depth[at == node][0] + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n >= 2 else 0))
    scores = np.floor(forest.scores(x) * quality.STEPS) / quality.STEPS
    allowed = [s for s in np.unique(scores) if (lost := (scores[good] >= s).sum()) <= 0.001 * good.sum() and (scores[~good] >= s).sum() > lost]
    assert threshold == min(allowed)


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (99, 1), (13, None), (0, 1)], "doc_id long, quality int")
    got = quality.judged(edge, labels).collect()
    assert len(got) == len(edge_rows()) and not any(r["kept"] for r in got if r["n_words"] < 10)
    assert quality.judged(none, labels).count() == 0 and quality.judged(edge, labels.where("false")).count() == len(got)
    kept = quality.filtered(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r["kept"] for r in got)


# Tokens


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_rank_files_encoding(spark, sf, edge):
    reference = encoding()
    odd = spark.createDataFrame([(100, "日本語🙂🙂  \t\n x² é​'ll <|endoftext|>"), (101, "\x00\x01" + "ab" * 3000), (102, "   ")], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd).union(edge.where("doc_id is not null").select("doc_id", "text"))
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = collections.Counter()
    for (doc, text), n in texts.items():
        ids = reference.encode_ordinary(text)
        want[doc, len(ids), sha(",".join(map(str, ids))), sha(text)] += n
    clashing = docs.selectExpr("*", "1 as n_tokens", "'x' as ids_sha256", "2 as ids")
    assert by_rows(byte_bpe.encoded(clashing, queries.BYTE_RANKS, public_tokenizers.PATTERN)) == want
    with_ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encoded(odd, queries.BYTE_RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    assert with_ids == {r["doc_id"]: reference.encode_ordinary(r["text"]) for r in odd.collect()}
    none = byte_bpe.encoded(edge.where("doc_id is null"), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert len(none) == 2 and {r["doc_id"] for r in none} == {None} and 0 in {r["n_tokens"] for r in none}
    assert byte_bpe.encoded(docs.where("false"), queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


ODD = ["Ünï aaa aaaa aaaaa bbbbbbb  zz.. a'S it's 'tis don't. x y ẛ̣ İstanbul ǅ ª º µ ß ΑΣ, Σίσυφος ﬁ 12345 ½ ２ a1b2 <|startoftext|> <|EndOfText|> x<|endoftext|>y é́ é",
       "\x1c \x85 a\u2003b 日本語 __a__ a_b -'s ,'s x'll! ''s \x00 a\x00b", None, "", "   ", "\t\n a", "a", "Word WORD wORD. (word) word*** word's word,s é. ÉTÉ,", "ab" * 5000, "x " * 9000]


def test_packing_keeps_each_id_once(spark, sf, edge, none):
    reference = Tokenizer.from_file(queries.WORD_TOKENIZER)
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd)
    clashing = edge.selectExpr("doc_id + 5000 as doc_id", "text", "1 as start", "2 as length", "3 as sequence_id", "4 as offset", "'x' as doc_tokens")
    pieces = packing.packed(docs, queries.WORD_TOKENIZER).collect() + packing.packed(clashing, queries.WORD_TOKENIZER).selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id - pow(2, 50) as sequence_id", "offset").collect()
    texts = collections.defaultdict(list)
    for r in docs.unionByName(clashing.select("doc_id", "text")).collect():
        texts[r["doc_id"]].append(r["text"] or "")
    own, filled = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    assert own.keys() == texts.keys()
    for doc, found in own.items():
        ids = [np.array(reference.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in texts[doc]]
        if len({len(x) for x in ids}) == 1 and len(ids) > 1:  # a repeated row: the pieces of each of its copies
            assert sum(n for _, n, _, _ in found) == sum(map(len, ids))
            continue
        for own_ids in ids:
            at = 0
            for start, length, crc, total in sorted(p for p in found if p[3] == len(own_ids)):
                assert start == at and zlib.crc32(own_ids[at : at + length]) == crc
                at += length
            assert at == len(own_ids)
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full, or cut at a power of two
    assert packing.packed(none, queries.WORD_TOKENIZER).count() == 0


def test_packer_places_documents_by_least_squares():
    packer = packing.Packer(window=8)
    for doc, size in enumerate([3, 5, 6, 7, 7, 7, 7, 20, 1]):
        packer.add(doc, np.full(size, doc))
    packer.finish()
    rows = packer.taken()
    assert sum(r[2] for r in rows) == 63
    totals = collections.Counter()
    for r in rows:
        totals[r[5]] += r[2]
    assert all(n <= 8 and n & (n - 1) == 0 for n in totals.values())


def test_packer_follows_the_rule_step_by_step():
    """Against all levels tried one by one; and what is cut anew is a small part."""
    random = np.random.default_rng(8)
    packer, counts = packing.Packer(window=64), collections.Counter()
    for doc, size in enumerate(random.integers(1, 64, 3000).tolist()):
        squares = lambda c: sum(n * n for level, n in c.items() if level < 64)
        tried = {}
        for level in [0, *(h for h in counts if counts[h] and h + size <= 64)]:
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += 1
            tried[level] = squares(after)
        assert tried[packer.level_for(size)] == min(tried.values())
        level = packer.level_for(size)
        packer.add(doc, np.full(size, doc))
        counts[level] -= level > 0
        if level + size < 64:
            counts[level + size] += 1
        assert all(packer.count[h] == counts[h] for h in range(1, 64))
    packer.finish()
    assert packer.moved < 0.05 * packer.placed
