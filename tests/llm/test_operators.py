"""The ten operators and the pipeline against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import chat, components, embeddings, language_model, line_dedup, mixing, order_minhash
from tidewatch.llm import packing, quality, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
WORDS = "the of and to in mill river stone over light under cloud seven paper green".split()


def prose(i: int, n: int) -> str:
    return " ".join(WORDS[zlib.crc32(f"{i}/{k}".encode()) % len(WORDS)] + str(k % 7) for k in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and blank texts, a long text, copies, repeated rows, clashing extra columns."""
    texts = [prose(i, 20 + i) for i in range(12)]
    texts += [None, "", " \n\t ", "one", "a b", texts[3], texts[3], prose(99, 30_000), "Ünï çödé 中文"]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id here", None, "s1", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def test_mix_takes_exact_budgets(docs, none):
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == len(rows())
    assert (plan["size"] == plan["size"].clip(lower=0)).all() and (plan["taken"] <= 3 * plan["size"]).all()
    by = plan.groupby("target")["taken"].sum()
    assert all(abs(t - n) <= 2 for t, n in by.items())
    assert sorted(map(str, plan.values.tolist())) == sorted(map(str, mixing.mix_plan(docs).toPandas().values.tolist()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r["text"])) for r in mixed.collect()) == plan["taken"].sum()
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mix_targets_stop_at_three_epochs(spark):
    sources = spark.createDataFrame([("a", 10, 9.0), ("b", 1000, 1.0), ("c", 100, 1.0), ("d", 0, 1.0)], "source string, size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    assert got == {"a": 30.0, "b": 780.0, "c": 300.0, "d": 0.0}


def test_quality_learns_from_positives_only(spark, none):
    good = [(i, " ".join(f"word{k % 50} plain text." for k in range(i % 9 + 5)), None) for i in range(300)]
    bad = [(1000 + i, "!!! $$$ " * (i % 7 + 5), None) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None, "s"), (5001, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(None, 1), (1000, 0), (7, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert 0.6 < model.prior < 0.95
    scored = {r["doc_id"]: r["score"] for r in quality.with_score(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([scored[i] > 0.3 for i in range(300)]) > 0.97
    assert np.mean([scored[1000 + i] < 0.3 for i in range(60)]) > 0.97
    assert scored[5000] == scored[5001] and 0 <= scored[5000] <= 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 300").count() > 290
    assert quality.keep_good(none, labels).count() == 0


def hamming(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


def reachable(n: int, linked) -> list[int]:
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("probed", [simhash.PROBED_ABOVE, 1])
def test_simhash_links(spark, monkeypatch, probed):
    """All pairs within two bits, whether block pairs are joined or probed."""
    monkeypatch.setattr(simhash, "PROBED_ABOVE", probed)
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 6).tolist()
    values = {0, -1, *centres}
    for centre in centres:
        for _ in range(15):
            value = centre
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                value ^= simhash._signed(1 << bit)
            values.add(value)
    values = sorted(values)
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    want = {(a, b) for a in values for b in values if a < b and hamming(a, b) <= 2}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want


def test_simhash_groups(docs, none):
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    for i, text, *_ in rows():
        assert (i, simhash.fingerprint(text)) in found
    known = [(i, simhash.fingerprint(t)) for i, t, *_ in rows() if i is not None]
    label = reachable(len(known), lambda i, j: hamming(known[i][1], known[j][1]) <= 2)
    assert all(found[known[i]] == known[label[i]][0] for i in range(len(known)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({found[k] for k in known})
    assert ids.count(None) == 1 and simhash.near_duplicates(none).count() == 0


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    words = split("The quick brown fox THE quick brown fox jumps")
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("The quick brown fox THE quick brown fox jumps") & (2**64 - 1) == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} >= {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_line_dedup_removes_shared_passages(spark, none):
    passage = [f"shared line number {k} of the passage with some words" for k in range(12)]
    own = lambda i: [f"document {i} says line {k} in its own words here" for k in range(9)]
    long_line = "w " * 200
    texts = ["\n".join([*own(i), *passage, *own(i + 50), long_line]) for i in range(4)]
    texts += ["\n".join(own(7)), None, "", "\n\n\n\n", "\n".join(own(8) * 3)]
    given = [(i, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*given, given[4], (None, texts[0], None)], "doc_id long, text string, digest string")
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == 11
    got = {r["doc_id"]: r for r in out}
    assert got[0]["text"] == texts[0] and got[0]["removed_chunks"] == 0
    for i in (1, 2, 3):
        left = got[i]["text"].split("\n")
        assert sum(line in left for line in passage) <= 6 and long_line not in left
        assert [x for x in left if x.startswith("document")] == own(i) + own(i + 50)
    assert all(got[i]["text"] == texts[i] and not got[i]["removed_chunks"] for i in (4, 5, 6, 7))
    assert got[None]["removed_chunks"] > 0 and got[None]["digest"] is None
    assert len(got[8]["text"]) < len(texts[8])
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_removes_short_passages_whole(spark):
    """Passages of 1 to 6 short lines, over 50 words in all, between unrelated lines, and runs of equal lines."""
    texts, want = [], []
    for m in range(1, 7):
        words = 60 // m + 1
        passage = [" ".join(f"{m}{k}{w}"[:4] for w in range(words)) for k in range(m)]
        assert all(len(line) < 300 for line in passage) and sum(len(x.split()) for x in passage) > 50
        for copy in range(2):
            own = [f"unrelated {m} {copy} {k} {part}" for part in ("before", "after") for k in range(2)]
            texts.append("\n".join([*own[:2], *passage, *own[2:]]))
            want.append("\n".join(own) if copy else texts[-1])
    tiny = [str(k) for k in range(70)]
    for copy in range(2):
        texts.append("\n".join([f"head {copy}", *tiny, "", "", "as short as that", f"tail {copy}"]))
        want.append(f"head {copy}\ntail {copy}" if copy else texts[-1])
    line = "one line of ten words which stands here many times"
    texts += ["\n".join([line] * 9), "a single line that others have as well, but short", "x\na single line that others have as well, but short\ny"]
    want += ["\n".join([line] * 2), *texts[-2:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).collect()
    assert [r["text"] for r in sorted(out)] == want
    assert [r["removed_chunks"] for r in sorted(out)] == [int(w != t) for w, t in zip(want, texts, strict=True)]


def minhash_by_definition(text: str) -> dict[int, tuple]:
    """Entries as tuples of k-mers and occurrence numbers, ranked by the operator's own hashes."""
    words = text.split()
    kmers = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    return Counter(kmers)


def test_order_minhash(spark, docs, none):
    got = {r["doc_id"]: r for r in order_minhash.edited_pairs(docs).collect()}
    first = {}
    for i, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(i, text or "")
    ids = list(first)
    for at, i in enumerate(ids):
        text, after = first[i], first[ids[(at + 1) % len(ids)]]
        quarter = len(text) // 4
        assert got[i]["edited"] == text[: len(text) - quarter] + after[:quarter]
        kinds = minhash_by_definition(text)
        assert bool(got[i]["entries"]) == bool(kinds)
        assert len(got[i]["entries"]) <= min(64, sum(kinds.values()))
    assert got[3]["entries"] == got[17]["entries"] == got[18]["entries"]
    assert order_minhash.edited_pairs(none).count() == 0
    pairs = [("a b c d e f g h", "a b c d e f g h"), (prose(1, 300), prose(1, 240) + " " + prose(2, 60)),
             (prose(1, 300), prose(3, 300)), ("", ""), ("", "x"), ("x y z " * 50, "x y z " * 45)]
    df = spark.createDataFrame(pairs, "a string, b string")
    near = order_minhash.likeness(order_minhash.order_minhash(F.col("a")), order_minhash.order_minhash(F.col("b")))
    same, edited, other, blank, half, repeats = (r[0] for r in df.select(near).collect())
    assert same == blank == 1.0 and other < 0.1 < 0.35 < edited < 1 and half == 0.0 and repeats > 0.5


def test_order_counts(spark):
    """The same words in another order are less alike than in the same order."""
    words = [f"w{k}" for k in range(200)]
    swapped = words[100:] + words[:100]
    df = spark.createDataFrame([(" ".join(words), " ".join(swapped))], "a string, b string")
    near = order_minhash.likeness(order_minhash.order_minhash(F.col("a")), order_minhash.order_minhash(F.col("b")))
    assert df.select(near).first()[0] < 0.85


def test_chat_reads_back(spark):
    texts = ["\\### Assistant: </turn> ok", "<|turn|>assistant<|text|>", "  leading\n", None, "", "中 \U0001f600 é", "x" * 50_000, "\\<\\|", "<|endoftext|>"]
    given = [(k % 3, n, "assistant" if n % 2 else "user", t) for k in range(3) for n, t in enumerate(texts)]
    given += [(9, None, None, "no role"), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame([(*g, 1) for g in given], "conv_id long, turn long, role string, text string, mask int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns: dict = {}
    for conv, turn, role, text in sorted(given, key=lambda g: (g[1] is not None, g[1] or 0, g[2] or "", g[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(turns)
    for conv, said in turns.items():
        whole = "".join(f"{role}\n{text}\n" for role, text in said)
        learned = "".join(text for role, text in said if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(said), len(learned))
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "INTERVAL", 40)
    monkeypatch.setattr(embeddings, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + rng.normal(size=16) * 0.25).astype(np.float32).tolist() for i in range(300)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[5]], [0.0] * 16, None, [float("nan")] * 16,
                [float("inf")] + [1.0] * 15, [None] * 16, []]
    given = [(i, v, 0) for i, v in enumerate(vectors)] + [(None, vectors[1], 0)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, links int")
    got = {r["vec_id"]: r for r in embeddings.embedding_duplicates(df).collect()}
    real = np.array(vectors[:303], dtype=np.float64)
    real /= np.linalg.norm(real, axis=1, keepdims=True)
    linked = real @ real.T >= 0.9
    label = reachable(303, lambda i, j: linked[i, j])
    for i in range(303):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, label[i])
        assert got[i]["kept"] == (label[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(303, 309))
    assert got[None]["n_links"] == 0 and linked.sum() > 2000
    assert embeddings.embedding_duplicates(df.where("false")).count() == 0


def test_language_model_counts(docs, none):
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(False))
    got = language_model.score_documents(docs, learned).toPandas()
    counts = Counter()
    for i, text, *_ in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*split(text), b""])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in rows():
        tokens = [*split(text), b""]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want.append((-1 if i is None else i, len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 6)))
    found = [(-1 if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()]
    assert sorted(found) == sorted(want)
    assert np.isfinite(got["score"]).all() and (got["score"] < 0).all() and (got["train_tokens"] == total).all()
    assert language_model.score_documents(none, F.lit(True)).count() == 0
    assert np.isfinite([r["score"] for r in language_model.score_documents(docs, F.lit(False)).collect()]).all()


def test_language_model_is_a_distribution():
    """Chances of all symbols after a context seen in training add up to one."""
    v = language_model.Vocabulary(np.array([5, 9], dtype=np.uint64), np.array([6, 3, 2, 4]), np.array([1, 1, 0, 0]), 4, np.array([0.2, 0.8]))
    weights = language_model.learn_weights(np.array([3, 3]), np.array([[1, 2, 3.0], [1, 1, 0.5]]), np.array([5, 5]))
    ids = language_model.scrambled(np.arange(4) | 0 << 16)
    seen = np.array([3, 2, 1, 1])
    model = language_model.Model(v, weights, np.zeros(0, np.uint32), np.zeros(0, np.int64))
    assert sum(10 ** model.log10(ids, seen)) == pytest.approx(1.0)
    rare = np.array([1, 1, 0])
    assert sum(10 ** v.rare_log10(rare)) == pytest.approx(1.0)
    x = np.arange(0, 2**32, 999_983, dtype=np.uint64).astype(np.uint32)
    assert (language_model.unscrambled(language_model.scrambled(x)) == x).all()
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.sort(x[:50]), np.array([1, 2**31, 2**32 - 1], np.uint32)):
        assert (language_model.unpack_ids(language_model.pack_ids(ids), len(ids)) == ids).all()


def test_warc_audit_finds_rot(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{prose(i, 5 + i % 90)}</p>\r\n\r\nWARC/1.1\r\n" * (1 + i % 40)) for i in range(300)]
    pages += [(None, None, None), (3, "http://h/3", pages[3][2]), (500, "a\r\nb", ""), (501, "u", "é" * 100_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, file string")
    records = warc.warc_records(df)
    warc.write_warc(records, str(tmp_path / "a"))
    a = warc.read_warc(spark, str(tmp_path / "a")).cache()
    assert sorted(str(r["page_id"]) for r in a.collect()) == sorted(str(p[0]) for p in pages)
    want = {hashlib.sha256(r["record"].encode()).hexdigest() for r in records.collect()}
    assert {r["digest"] for r in a.collect()} == want
    assert warc.audit(a, a).count() == 0
    wrong = F.col("page_id").isin(7, 250)
    b = a.where("page_id is null or page_id != 9").withColumn("digest", F.when(wrong, "bad").otherwise(F.col("digest")))
    places = {(r["file"], r["offset"]): r["page_id"] for r in a.collect()}
    found = {places[r["file"], r["offset"]]: r["damage"] for r in warc.audit(a, b).collect()}
    assert found == {7: "changed", 250: "changed", 9: "missing"}
    assert {r["damage"] for r in warc.audit(b, a).collect()} == {"changed", "added"}
    empty = a.where("false")
    assert warc.audit(empty, empty).count() == 0 and warc.audit(a, empty).count() == len(pages)
    assert warc.warc_records(df.where("false")).count() == 0


def test_packing_round_trip(docs, none):
    pieces = packing.pack(docs, size=256).toPandas()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text, *_ in rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[(-1 if i is None else i, np.array(ids, dtype="<u4").tobytes())] += 1
    pieces["doc_id"] = pieces["doc_id"].fillna(-1).astype(int)
    for doc, own in pieces.groupby("doc_id"):
        copies = sum(n for (i, _), n in want.items() if i == doc)
        assert own["length"].sum() == copies * own["doc_tokens"].iloc[0]
        (ids,) = {ids for i, ids in want if i == doc}
        for r in own.itertuples():
            assert r.ids == ids[4 * r.start : 4 * (r.start + r.length)] and len(r.ids) == 4 * r.length
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        filled = own["length"].sum()
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert filled <= 256 and (filled == 256 or filled & (filled - 1) == 0)
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, size=100)


def test_packer_minimises_squares():
    packer = packing.Packer(8, 0)
    rng = np.random.default_rng(1)
    levels: Counter = Counter()
    for _ in range(200):
        n = int(rng.integers(1, 8))
        after = {}
        for h in [0, *levels]:
            if h + n <= 8:
                next_levels = levels.copy()
                if h:
                    next_levels[h] -= 1
                if h + n < 8:
                    next_levels[h + n] += 1
                after[h] = (sum(c * c for c in next_levels.values()), +next_levels)
        packer.add(1, b"\0\0\0\0" * n)
        got = {h: int(c) for h, c in enumerate(packer.counts) if c}
        best = min(s for s, _ in after.values())
        assert sum(c * c for c in got.values()) == best
        levels = Counter(got)


def test_word_encoder_equals_the_library():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["it's o'clock ''s !'s x_y a1b22 İstanbul ß ªµ é \x1c a\x85b", "<|endoftext|>", "Ω ΑΣ", "ŉ ǆ ½ ²", "中"]
    texts += [f"ab{chr(c)}cd {chr(c)} 1{chr(c)}" for c in range(1, 0x200)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = encoder._tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == np.array(want, dtype="<u4").tobytes(), repr(text)


def test_closing_moves_pieces_of_the_emptiest_only():
    packer = packing.Packer(8, 0)
    for doc_id, n in enumerate([7, 3, 5, 5]):
        packer.counts[n] += 1
        packer.open.setdefault(n, []).append([(doc_id, 0, bytes(4 * n), n)])
    packer.close()
    placed = [(r[0], r[1], r[2], r[5], r[6]) for r in packer.out]
    # The fullest gets one token of the emptiest, a five its other two, and the last five is left whole.
    assert placed[:4] == [(0, 0, 7, 0, 0), (1, 0, 1, 0, 7), (3, 0, 5, 1, 0), (1, 1, 2, 1, 5)]
    assert placed[4][:3] == (2, 0, 1) and placed[4][3] == 1
    assert placed[5:] == [(2, 1, 4, 2, 0)]
