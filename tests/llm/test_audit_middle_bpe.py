"""Filter audit, fill-in-middle and byte-level BPE against brute force on edge cases and small tables."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from pitchloom.llm import byte_bpe, fill_in_middle as fim, filter_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, rank int, ids string, output string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, extra clashing columns."""
    plain = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, plain, "en"), (2, plain, "en"), (3, plain, None), (4, None, "en"), (5, "", "de"), (6, " \t\n ", "de"),
        (None, plain, "en"), (None, None, None), (7, "One two THREE", "en"), (7, "One two THREE", "en"), (7, "other", "de"),
        (8, "x" * 200_000, "fr"), (9, "ab # " * 60_000, "fr"), (10, "é中😀 ÀB " * 20, "fr"), (11, "a<P>b c", "en"),
        (12, "\n\n lead and trail \x0b\f", "en"), (13, " ".join(["same"] * 300), "en"), (14, "<<S< x> <M" * 9, ""),
    ] + [(i, f"some words number {i} here  ", "en") for i in range(20, 60)]
    return spark.createDataFrame([(*r, "a", 1, 5, 6, "extra", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (7, 1, 1), (None, 1, 1), (9, 0, 1), (21, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def brute_audit(docs, labels):
    """Every order, every step, every document."""
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text] = min(smallest.get(text, i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, removals = {}, Counter()
    facts = []
    for i, text, part in docs:
        words = WORD.findall(text)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                  "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                  "E": i is not None and i > smallest[text]}
        facts.append((part, {f for f in failed if failed[f]}, i in good, i in toxic))
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in facts}:
            rows = [f for f in facts if f[0] == part]
            for step, own in enumerate(order, 1):
                out = [f for f in rows if own in f[1] and not f[1] & set(order[:step - 1])]
                removals[part, own] += len(out)
                found[part, order, step] = (
                    sum(not f[1] & set(order[:step]) for f in rows), len(out),
                    sum(own in f[1] for f in rows) - len(out), sum(f[1] == {own} for f in rows),
                    sum(f[2] for f in out), sum(f[3] for f in out))
    return {key: (*value, removals[key[0], key[1][key[2] - 1]]) for key, value in found.items()}


def test_audit_matches_brute_force(spark, sf, edges, none, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    small = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for docs, marks in ((edges, labels), small):
        rows = filter_audit.audit(docs, marks).collect()
        found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
        assert len(rows) == len(found)
        given_docs = [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in docs.collect()]
        assert found == brute_audit(given_docs, [tuple(r) for r in marks.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.audit(none, labels).count() == 0
    bare = labels.where("false")
    assert {r["good_lost"] for r in filter_audit.audit(edges, bare).collect()} == {0}


def test_intervals_tile_the_ranks():
    """At each step every rank sees a mask once at most, and the interval's orders share its verdict."""
    seen = Counter()
    for mask, step, low, high, kept, removed, redundant, only in filter_audit.intervals():
        for rank in range(low, high):
            order = filter_audit.ORDERS[rank]
            now = bool(mask & filter_audit.bit(order[step - 1]))
            before = any(mask & filter_audit.bit(c) for c in order[:step - 1])
            assert (kept, removed, redundant) == (not now and not before, now and not before, now and before)
            assert only == (mask == filter_audit.bit(order[step - 1]))
            seen[mask, step, rank] += 1
    assert set(seen.values()) == {1} and filter_audit.ORDERS == sorted(filter_audit.ORDERS)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 3 * fim.BLOCK)), st.lists(st.tuples(st.integers(0, 2 * fim.BLOCK), st.integers(1, 9000)), max_size=3))
def test_boundary_sets_select_like_sorted_lists(single, runs):
    values = sorted(single | {v for start, size in runs for v in range(start, start + size)})
    offsets, kept = np.array(values, np.int64), fim.BoundarySet()
    for high in sorted(set((offsets // fim.BLOCK).tolist())):
        kept.add_block(high, offsets[offsets // fim.BLOCK == high] % fim.BLOCK)
    assert len(kept) == len(values)
    assert all(kept.select(k) == values[k] for k in range(0, len(values), max(1, len(values) // 50)))


def test_each_kind_of_container_is_chosen():
    rng = np.random.default_rng(0)
    few, many = np.array([3, 9, 70]), np.sort(rng.choice(fim.BLOCK, 20_000, replace=False))
    run = np.concatenate([np.arange(100, 9000), np.arange(20_000, 20_005)])
    for values, kind in ((few, fim.ArrayContainer), (many, fim.BitmapContainer), (run, fim.RunContainer)):
        made = fim.container(values)
        assert type(made) is kind
        assert [made.select(k) for k in range(len(values))] == values.tolist()


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_match_brute_force(spark, sf, edges, none):
    for docs in (edges, spark.read.parquet(f"{sf}/documents.parquet")):
        given_docs = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        want = [(i, *brute_middle(i, t)) for i, t in given_docs]
        assert Counter(tuple(r) for r in fim.transform(docs).collect()) == Counter(want)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        rows = Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fim.report(docs).collect())
        assert rows == Counter((i, digest(w[-1]), digest(t)) for (i, t), w in zip(given_docs, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.report(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \t\n<PSM>é😀", max_size=40), st.integers(0, 500))
def test_texts_come_back_from_outputs(text, doc_id):
    assert fim.rearrange(doc_id, text.encode())[:4] == brute_middle(doc_id, text)[:4]
    assert fim.rearrange(doc_id, text.encode())[4].decode() == brute_middle(doc_id, text)[4]


def test_ends_of_long_texts_cross_blocks():
    text = ("word " * 50_000 + "\n" * 70_000 + "é" * 80_000 + " z ").encode()
    ends, kept = [], fim.unit_ends(text)
    for unit in UNIT.findall(text.decode()):
        ends.append((ends[-1] if ends else 0) + len(unit.encode()))
    assert len(kept) == len(ends) and [kept.select(k) for k in range(len(ends))] == ends


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.BytePairs(public_tokenizers.path(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reader():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, sf, edges, none, reader):
    for docs in (edges, spark.read.parquet(f"{sf}/documents.parquet")):
        given_docs = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        want = Counter((i, tuple(reader.encode_ordinary(t))) for i, t in given_docs)
        coded = byte_bpe.encode(docs)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == want
        back = Counter((r["doc_id"], bytes(r["bytes"])) for r in byte_bpe.decode(coded).collect())
        assert back == Counter((i, t.encode()) for i, t in given_docs)
        digests = Counter(tuple(r) for r in byte_bpe.report(docs).collect())
        assert digests == Counter(
            (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            for i, t in given_docs for ids in [reader.encode_ordinary(t)])
    assert byte_bpe.report(none).count() == 0


def test_long_words_in_rounds(pairs, reader, monkeypatch):
    rng = random.Random(3)
    words = ["a" * 5001, "ab" * 900, "aab" * 700, "中文字符" * 300, "=-" * 2000, " " * 900 + "x"]
    words += ["".join(rng.choice(letters) for _ in range(1500)) for letters in ("ab", "etaoin", "aAbB", "éa中", "abcdefghijklmnop")]
    monkeypatch.setattr(byte_bpe, "ROUND_ROWS", 4000)
    assert [ids.tolist() for ids in pairs.encode(words)] == [reader.encode_ordinary(w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_texts(pairs, reader, texts):
    ids = pairs.encode(texts)
    assert [some.tolist() for some in ids] == [reader.encode_ordinary(t) for t in texts]
    assert [b"".join(parts).decode() for parts in pairs.decode(ids)] == texts


def test_held_words_are_dropped_and_learnt_again(pairs, reader, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD_WORDS", 30)
    monkeypatch.setattr(byte_bpe, "GROUP_WORDS", 20)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 40)
    monkeypatch.setattr(byte_bpe, "DECODE_ROWS", 7)
    text = " ".join(f"zq{i}xk don't  \n" for i in range(50)) + "   end"
    assert pairs.encode([text, text])[1].tolist() == reader.encode_ordinary(text)
    assert b"".join(pairs.decode(pairs.encode([text]))[0]).decode() == text
    with pytest.raises(ValueError):
        pairs.decode([np.array([60_000], np.int32)])
