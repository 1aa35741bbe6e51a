"""Ranked search, collocations and URL filters against brute force, on small tables with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import collocations, ranking, url_rules
from tidewatch.session import settle

DOCS = "doc_id long, text string, lang string, rank int, score string, fan string, shard int"


@pytest.fixture
def small_windows(monkeypatch):
    """Many segments, slices and windows, so that skipping has something to skip."""
    for name, value in {"WINDOW": 4, "SEGMENT_DOCS": 16, "SLICE_BYTES": 40, "LONG_SHARE": 0.2}.items():
        monkeypatch.setattr(ranking, name, value)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"BLOCK_TOKENS": 50, "HELD_TOKENS": 120, "SLICE_BYTES": 30}.items():
        monkeypatch.setattr(collocations, name, value)


def frame(spark, rows: list[tuple], parts: int = 3):
    rows = [(i, t, lang, 1, "x", "y", 2) for i, t, lang in rows]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def some_docs(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Ünï", "中文", "x-y", "A.B"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [
        (i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40))), draw.choice(["en", "de", None]))
        for i in range(n)
    ]
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " \t\n", "de"), (None, rows[0][1], "en"), rows[1], rows[1]]
    rows.append((n + 3, " ".join(draw.choices(words, weights, k=3000)), "en"))
    return rows


def ranked_by_definition(docs: list[tuple], text: str | None, best: int) -> list[tuple]:
    def terms(value):
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", value or "")
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]

    held = [(i, Counter(terms(t))) for i, t, _ in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for i, c in held:
        m, score = 50 + 50 * c.total() * n // total, 0
        for t in set(terms(text)) & c.keys():
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
        if score > 0:
            found.append((-score, i is None, i))
    return [(k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]


@pytest.mark.parametrize("best", [3, 50])
def test_ranking(spark, small_windows, best):
    docs = some_docs(1, 150)
    asked = [(0, "w0 w1 w5 w29"), (1, "W2, w2; w25"), (2, None), (3, "nothing known"), (4, "ünï 中文 y"), (0, "w7"), (None, "w3")]
    items = spark.createDataFrame([(i, t, "z") for i, t in asked], "item_id long, text string, query string")
    got = defaultdict(list)
    for r in ranking.search(ranking.build_index(frame(spark, docs)), items, best).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    want = defaultdict(list)
    for i, t in asked:
        want[i] += ranked_by_definition(docs, t, best)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items() if v}


def test_ranking_in_blocks_and_of_nothing(spark, monkeypatch):
    docs = some_docs(2, 40)
    items = spark.createDataFrame([(i, f"w{i} w{i + 3}") for i in range(8)], "item_id long, text string")
    index = ranking.build_index(frame(spark, docs))
    whole = sorted(ranking.search(index, items, 5).collect())
    monkeypatch.setattr(ranking, "TERMS_TOGETHER", 3)
    assert sorted(ranking.search(index, items, 5).collect()) == whole
    assert ranking.search(ranking.build_index(frame(spark, [], 1)), items).count() == 0
    assert ranking.search(index, items.where("false")).count() == 0


def test_ranking_writes_segments_as_they_gather(spark, small_windows, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP_BYTES", 1 << 10)
    index = ranking.build_index(frame(spark, some_docs(3, 150), 1))
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.inputFiles()]
    groups = [f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)]
    assert sum(groups) == index.count() >= 10
    assert max(groups) <= 2


def test_ranking_holds_one_segment_at_a_time(spark, small_windows, monkeypatch):
    class Alone(ranking.SegmentSearch):
        def __init__(self, segment, *rest) -> None:
            # The lists of a later row of a batch begin where those of the rows before end.
            assert all(values.offset == 0 for values in segment.values()), "segments came together"
            super().__init__(segment, *rest)

    key = "spark.sql.parquet.columnarReaderBatchSize"
    index = ranking.build_index(frame(spark, some_docs(4, 150), 1))
    files, usual, decoded = set(index.inputFiles()), spark.conf.get(key), []

    def settled(df, **options):
        if files & set(df.inputFiles()):
            decoded.append(spark.conf.get(key))
        return settle(df, **options)

    monkeypatch.setattr(ranking, "SegmentSearch", Alone)
    monkeypatch.setattr(ranking, "settle", settled)
    items = spark.createDataFrame([(0, "w0 w1"), (1, "w2")], "item_id long, text string")
    assert ranking.search(index, items, 5).count() == 10
    assert decoded == ["1", "1"]
    assert spark.conf.get(key) == usual


def phrases_by_definition(docs: list[tuple], at_least: int) -> tuple[dict, Counter]:
    f, words = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            said = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(said)
            f[lang].update(tuple(said[i : i + n]) for n in range(1, 5) for i in range(len(said) - n + 1))
    return {(lang, " ".join(p)): c for lang, counts in f.items() for p, c in counts.items() if c >= at_least}, words


def collocations_by_definition(docs: list[tuple], at_least: int, best: int) -> list[tuple]:
    f, words = phrases_by_definition(docs, at_least)
    found = defaultdict(list)
    for (lang, phrase), a in f.items():
        said = phrase.split(" ")
        if len(said) == 1:
            continue
        cuts = []
        for k in range(1, len(said)):
            left, right = f[lang, " ".join(said[:k])], f[lang, " ".join(said[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        covered = any(
            other == lang and len(p.split(" ")) > len(said) and f" {phrase} " in f" {p} " and 100 * c >= 80 * a
            for (other, p), c in f.items()
        )
        if not covered:
            found[lang].append((-score, -a, phrase.encode(), phrase, a, left, right, words[lang], score))
    return [(lang, rank + 1, *row[3:]) for lang, rows in found.items() for rank, row in enumerate(sorted(rows)[:best])]


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations(spark, small_blocks, shards):
    draw = random.Random(3)
    fixed = ["new york city hall", "San Francisco bay", "a\x00b c d", "中文 字"]
    docs = some_docs(4, 60)
    docs += [(1000 + i, f"w1 {draw.choice(fixed)}. {draw.choice(fixed)}\t{draw.choice(fixed)}", "en") for i in range(120)]
    docs.append((5000, "one piece without an end " * 200, "fr"))
    got = collocations.collocations(frame(spark, docs, 4), at_least=12, best=25, shards=shards)
    assert sorted(map(tuple, got.collect())) == sorted(collocations_by_definition(docs, 12, 25))


def test_crowded_slots_count_no_phrase_wrong(spark, small_blocks, monkeypatch):
    """With 32,768 entries shared by all and few shards, whatever shares one is told apart exactly."""
    monkeypatch.setattr(collocations, "SLOT_BITS", 4)
    docs = some_docs(5, 80)
    phrases, _ = collocations.frequent_phrases(frame(spark, docs, 4), at_least=6, shards=3)
    want, _ = phrases_by_definition(docs, 6)
    assert {(r["lang"], r["phrase"]): r["f"] for r in phrases.collect()} == want


def test_all_of_a_language_in_one_block(spark):
    docs = [(i, "so so so so we go on", "de") for i in range(20)] + [(99, "a b c d " * 20, "en")]
    got = collocations.collocations(frame(spark, docs, 1), at_least=15, best=50)
    assert sorted(map(tuple, got.collect())) == sorted(collocations_by_definition(docs, 15, 50))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [], 1)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en")], 1)).count() == 0


PAGES = "page_id long, url string, html string, host int, verdict string, key string"


def judged(spark, rows: list[tuple], redirects: list[tuple] = ()) -> dict:
    pages = spark.createDataFrame([(i, u, h, 0, "v", "k") for i, u, h in rows], PAGES)
    more = spark.createDataFrame(list(redirects), "url string, target string")
    rules = url_rules.rule_table(spark, url_rules.RULES)
    got = url_rules.judge(pages, rules, more).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def canonical(url: str) -> str:
    return f'<html><head><LINK REL="x canonical" href="{url}"></head></html>'


def test_rules(spark):
    got = judged(
        spark,
        [
            (1, "http://a.Example.COM/en/x?q=/y#z", None),
            (2, "https://www.example.com/en/x", ""),
            (3, "https://x.www.example.com/en/x", ""),
            (4, "http://example.com/fr/", ""),
            (5, "http://notexample.com/en/", ""),
            (6, "http://a.net/es/1", ""),
            (7, "http://a.net/en/1", ""),
            (8, "http://example.com", ""),
            (9, None, ""),
            (10, "no scheme.net/es/", ""),
            (11, "x://y://net/es/", ""),
            (12, "http://net/fr/", ""),
            (13, "http://a..com/", ""),
            (13, "http://a..com/", ""),
        ],
    )
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        3: ("x.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        4: ("example.com", "/fr/", "com/", "allow"),
        5: ("notexample.com", "/en/", "com/", "allow"),
        6: ("a.net", "/es/1", "net/es/", "block"),
        7: ("a.net", "/en/1", None, "allow"),
        8: ("example.com", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("y:", "//net/es/", None, "allow"),
        12: ("net", "/fr/", "net/fr/", "block"),
        13: ("a..com", "/", "com/", "allow"),
    }


def test_blocks_spread_to_aliases_without_a_rule(spark):
    chain = [(100 + i, f"http://h{i}.org/p", canonical(f"http://h{i + 1}.org/p")) for i in range(12)]
    rows = [
        *chain,
        (1, "http://b.org/one", canonical("http://bad.net/es/1")),
        (2, "http://b.org/two#part", '<meta content="0; URL=\'/one\'" http-equiv=refresh>'),
        (3, "http://good.com/three", canonical("http://b.org/one")),
        (4, "http://b.org/four", '<!-- <link rel=canonical href="/one"> --><script>"<link rel=canonical href=/one>"</script>'),
        (5, "http://b.org/dir/five", '<base href="http://c.org/"><link rel=canonical href="six">'),
        (6, "http://c.org/six", None),
        (7, "http://c.org/seven", canonical("http://[broken/")),
        (8, "http://B.org/two#other", ""),
        (9, None, canonical("http://bad.net/es/1")),
        (10, "http://d.org/long", "x" * 300_000 + canonical("http://bad.net/es/1")),
        (11, "http://e.org/sent", ""),
    ]
    got = judged(spark, rows, [("http://e.org/sent", "http://c.org/six"), ("http://c.org/six", "http://x.net/fr/"), ("http://h12.org/p", "http://x.net/fr/"), (None, "http://x.net/fr/")])
    blocked = {i for i, row in got.items() if row[3] == "block"}
    assert blocked == {1, 2, 5, 6, 8, 10, 11, *range(100, 112)}
    assert all(got[i][2] is None for i in blocked) and got[3][2:] == ("com/", "allow")


def test_many_rules_ties_and_no_rules(spark):
    rules = [("block", "com", f"/{i}/") for i in range(300)] + [("allow", "com", "/7/"), ("block", "com", "/abc"), ("allow", "bc.com", "/"), ("deny", "com", "/"), ("block", None, "/"), ("block", "", "/")]
    pages = spark.createDataFrame([(1, "http://x.com/7/"), (2, "http://x.com/8/y"), (3, "http://bc.com/abc"), (4, "http://x.org/8/")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    got = url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {
        1: ("com/7/", "allow"), 2: ("com/8/", "block"), 3: ("bc.com/", "allow"), 4: (None, "allow"),
    }
    none = url_rules.rule_table(spark, [])
    assert {r["verdict"] for r in url_rules.judge(pages, none).collect()} == {"allow"}
    assert url_rules.judge(pages.where("false"), none).count() == 0
