"""Corpus operators against brute force, on edge cases and small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pitchloom.llm import (
    common, maxent_lm, mixing, packing, pii_bootstrap, pipeline_stages, repetition, secret_scan, simhash,
    subspace_join, toxicity, warc,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, n string"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, extra clashing columns."""
    base = " ".join(f"word{i % 97} of{i % 13}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base + " more", "en", "a", 1), (3, base, None, None, None),
        (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, " \t\n ", "de", "b", 3), (7, "one two", "en", "a", 7),
        (None, "no id here", "en", "c", 9), (8, "x" * 300_000, "en", "c", 300_000), (9, "ab " * 60_000, "en", "c", 1),
        (10, "mail a.b@c.org or +1 (017) 555-7713 now 4845168114407329 at 10.0.0.1", "en", "a", 5),
        (10, "mail a.b@c.org or +1 (017) 555-7713 now 4845168114407329 at 10.0.0.1", "en", "a", 5),
        (11, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y 1234567890123456 z', "en", "a", 5),
        (12, "é中😀 ÀB " * 20, "fr", "a", 5),
    ]
    return spark.createDataFrame([(*r, "extra", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
        if new == root:
            return root
        root = new
    return root


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 540)} | {8: 8, 9: 8}


def test_simhash_matches_brute_force(spark, sf, edges, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        edges.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = Counter((i, f"{brute_fingerprint(t):016x}") for i, t in texts_of(docs))
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == want
    prints = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    linked = [np.flatnonzero(np.bitwise_count(p ^ prints) <= 4) for p in prints]
    roots, least = brute_components(len(rows), linked), defaultdict(list)
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root].append(r["doc_id"])
    assert all(r["component_id"] == min(least[root], default=None) for r, root in zip(rows, roots))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(edges)
    assert kept.columns == edges.columns and kept.where("doc_id = 10").count() == 2


def test_bit_sliced_links_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**62))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)})
    monkeypatch.setattr(simhash, "PART", 16)
    table = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    found = {r["node"]: r["root"] for r in common.components(simhash.links(table)).collect()}
    prints = np.array(values, np.uint64)
    roots = brute_components(len(values), [np.flatnonzero(np.bitwise_count(p ^ prints) <= 4) for p in prints])
    groups = defaultdict(set)
    for v, root in zip(prints.astype(np.int64).tolist(), roots):
        groups[root].add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1.7, "d": 0.1}, {"a": 1}, {i: 1 for i in range(7)}])
def test_pfair_schedule_stays_within_one_block(weights):
    given = mixing.shares(weights, 500)
    assert sum(given.values()) == 500
    assert mixing.deviation(mixing.schedule(given), given) < 1


def test_mix_places_every_document_and_keeps_shares(spark, edges, none):
    rows = mixing.mix(edges, block_chars=1000, carry=("doc_id", "source", "n")).collect()
    first = Counter(r["doc_id"] for r in rows if r["pass"] == 0)
    assert first == Counter(r["doc_id"] for r in edges.collect())
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    weights = {"big": 4, "s0": 1, "s1": 1, "s2": 2, "s3": 1, "s4": 1}
    placed = mixing.mix(docs, weights, block_chars=1000).collect()
    assert {r["doc_id"] for r in placed if r["pass"] == 0} == set(range(4000))
    owner = {r["slot"]: r["source"] for r in placed}
    assert sorted(owner) == list(range(len(owner)))
    given = mixing.shares(weights, mixing.PERIOD)
    had = Counter()
    for at in range(len(owner)):
        had[owner[at]] += 1
        assert all(abs(had[s] - (at + 1) * given[s] / mixing.PERIOD) < 1 for s in given)
    per_block = Counter((r["slot"]) for r in placed)
    assert set(per_block.values()) == {10}
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns and mixed.count() >= edges.count()
    with pytest.raises(ValueError):
        mixing.mix(edges, {"a": 1.0})


def test_packing_covers_every_id_once(spark, edges, none):
    pieces = packing.pack(edges.where("doc_id is not null and doc_id <> 10"), with_ids=True).collect()
    tokenizer = packing.WordTokenizer(packing.public_tokenizers.path(packing.TOKENIZER))
    of = defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
    for doc_id, text in texts_of(edges.where("doc_id is not null and doc_id <> 10")):
        ids = [i for p in sorted(of[doc_id], key=lambda p: p["start"]) for i in p["ids"]]
        direct = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert ids == direct and {p["doc_tokens"] for p in of[doc_id]} == {len(direct)}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == parts[0]["context"] and at & (at - 1) == 0 and at <= 4096
    assert packing.pack(none).count() == 0
    assert packing.pack(edges).where("doc_id = 10").agg(F.sum("length")).first()[0] == 2 * packing.pack(
        edges.where("doc_id = 10").limit(1)).first()["doc_tokens"]


def test_tokens_by_word_are_those_of_the_text():
    tokenizer = packing.WordTokenizer(packing.public_tokenizers.path(packing.TOKENIZER))
    for text in ("", "don't <|endoftext|> stop", "Σίσυφος ΣΑΣ.", "a b c\x85d", "é ́x İ ǅ ﬁ", "日本語 12345 ½", "~ a~b ~~", "x  \x00 z​q", "<|ENDOFTEXT|> A'S 'S's I'LL <|startoftext|>, Don'T"):
        assert tokenizer.ids(text.encode()).tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_warc_round_trip(spark, tmp_path):
    schema = "page_id bigint, url string, html string, record_type string"
    rows = [(1, "http://x/1", "<p>é中</p>"), (2, "http://x/2", "<p>é中</p>"), (3, None, None), (4, "u\r\nx", ""),
            (None, "n", ""), (5, "http://x/5", "y" * 200_000), (6, "a", "\r\n\r\nWARC/1.1"), (6, "a", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert (by_id[1]["record_type"], by_id[1]["refers_to"]) == ("revisit", 2)
    assert by_id[2]["payload"].decode() == "<p>é中</p>" and by_id[2]["record_type"] == "response"
    assert by_id[3]["refers_to"] == 4 and by_id[None]["refers_to"] == 4 and by_id[4]["payload_bytes"] == 0
    assert all(r["record_type"] == "response" for r in got if r["page_id"] == 6)
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert by_id[page_id]["payload_bytes"] == len(data)
        assert by_id[page_id]["payload_digest"] == warc.payload_digest(data)
    assert warc.archived_pages(spark.createDataFrame([], schema)).count() == 0


def test_damaged_archives_are_refused():
    record = warc._record(1, "u", b"data", warc.payload_digest(b"data"), None, warc.DATE)
    assert warc.parse_record(record)["payload"] == b"data"
    for bad in (record[:-2], record.replace(b"data", b"dada"), record.replace(b"WARC/1.1", b"WARC/9.9"),
                record.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    archive = warc.SEPARATOR + warc.zstandard.ZstdCompressor().compress(record)
    assert [data for _, data in warc.records(archive)] == [record]
    for bad in (archive[:-3], archive[:5], b"12345678" + archive):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def brute_repeats(words):
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)

    def covered(least):
        return len({p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])})

    return n, covered(3), covered(5), max(longest, default=0)


def test_repeats_match_brute_force(edges, none):
    rng = np.random.default_rng(1)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c"], rng.integers(0, 40)).tolist()) for _ in range(60)] + [b"", b"x " * 60]
    found = repetition.measure(texts)
    assert [(r[0], r[4], r[5], r[6]) for r in found.tolist()] == [brute_repeats(t.split()) for t in texts]
    text = "a b#\n\na b#\n é$中 <x>\n"
    assert repetition.measure([text.encode()])[0, :4].tolist() == [6, 12, 5, 1]
    rows = {r["doc_id"]: r for r in repetition.quality(edges).collect()}
    assert rows[4]["n_words"] == 0 and rows[4]["base_failed"] and not rows[4]["kept"]
    assert rows[9]["longest_repeat"] == 59_999 and not rows[9]["kept"]
    assert repetition.quality(none).count() == 0 and repetition.quality(edges).count() == edges.count()


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([c + 0.05 * rng.standard_normal((14, 16)) for c in centres]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(200, rows[0][1], 0), (201, (2 * x[0]).tolist(), 0), (201, rows[0][1], 0)]
    bad = [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, rows[0][1], None),
           (305, [None, 1.0], 0), (306, [float("inf")] * 16, 0), (307, [1.0, 2.0], 0), (308, [float("nan"), 1.0], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id bigint, embedding array<float>, label int, node string")
    monkeypatch.setattr(subspace_join, "PART", 8)
    found = subspace_join.near_vectors(table).collect()
    assert len(found) == len(rows) + len(bad)
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    roots = brute_components(len(rows), [np.flatnonzero(n) for n in near])
    want = Counter((r[0], int(near[i].sum()), rows[roots[i]][0]) for i, r in enumerate(rows))
    want.update((r[0], 0, r[0]) for r in bad)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == want
    assert max(near.sum(axis=1)) > 3 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert subspace_join.near_vectors(table.limit(0)).count() == 0


FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = []
    for number, (kind, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data_base_matches_python(spark, edges, none):
    hard = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 " + "0" * 50 + "1.2.3.4", "4845168114407329 7536784127813050",
            "+1 (017) 555-7713++1 (974) 555-3436 ", "é中 a.b@c-d.e.f😀 10.0.0.1", "a@b a@b. @x.y a@@b.c", "5" * 5000,
            "4845168114407329@x.org", "0" * 16 + "4.1.1.1", "00004845168114407329.1.1.1", "1.2.3." + "9" * 60,
            "a" * 50_000, "1 " * 5000, "+1" + " " * 5000 + "2", "a@b.c" * 300]
    docs = edges.select("doc_id", "text", "n").union(spark.createDataFrame(
        [(100 + i, t, "") for i, t in enumerate(hard)], "doc_id bigint, text string, n string"))
    got = Counter((r["doc_id"], r["base_sha256"]) for r in pii_bootstrap.report(docs).collect())
    assert got == Counter((i, hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t in texts_of(docs))
    assert pii_bootstrap.report(none).count() == 0
    plan = pii_bootstrap.report(edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(edges).collect()}
    assert clean[10] == "mail <EMAIL> or <PHONE> now <CARD> at <IP>" and clean[4] is None


def test_contexts_discover_unseen_identifiers(spark, monkeypatch):
    docs = [(i, f"words here please call +1 (017) 555-77{i:02d} today v1.{i}.22x") for i in range(10, 30)]
    docs += [(i, f"words here please call 555-0{i}-44 today") for i in range(30, 36)]
    docs += [(i, f"words and then the 555-0{i}-44 of it") for i in range(40, 60)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pii_bootstrap.learn_patterns(table) == [("please call", 3)]
    spans = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(table).collect()}
    assert spans[30] == "phone:23:33" and spans[41] == "" and spans[12] == "phone:23:40"
    # Patterns beyond the bound of the map are joined; repeated rows and nulls keep their spans.
    doubled = table.union(table).union(spark.createDataFrame([(None, None), (7, "")], table.schema))
    by_map = Counter(map(tuple, pii_bootstrap.report(doubled).collect()))
    monkeypatch.setattr(pii_bootstrap, "MAP_PATTERNS", 0)
    assert Counter(map(tuple, pii_bootstrap.report(doubled).collect())) == by_map
    monkeypatch.setattr(pii_bootstrap, "BUCKETS", 1)
    assert pii_bootstrap.learn_patterns(table) == [("please call", 3)]


def test_discovered_identifiers_teach_new_contexts(spark):
    """Seeds -> please call -> identifiers -> ticket number -> another identifier, which no seed is near."""
    docs = [(i, f"words here please call +1 (017) 555-77{i:02d} today") for i in range(10, 30)]
    docs += [(i, f"words here please call 555-0{i}-44 today") for i in range(30, 34)]
    docs += [(i + 100, f"words with ticket number 555-0{i}-44 today") for i in range(30, 34)]
    docs += [(200, "words with ticket number 555-099-44 today"), (201, "words with plain value 555-098-44 today")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pii_bootstrap.learn_patterns(table) == [("please call", 3), ("ticket number", 3)]
    spans = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(table).collect()}
    assert spans[200] == "phone:25:35" and spans[201] == ""


def test_language_model_counts_and_beats_its_base(spark, edges, none, monkeypatch):
    rows = [(i, " ".join(f"w{(i + j * j) % 11} then" for j in range(30)), None) for i in range(200)]
    docs = edges.select("doc_id", "text", "n").union(spark.createDataFrame(rows, "doc_id bigint, text string, n string"))
    monkeypatch.setattr(maxent_lm, "DICTIONARY_WORDS", 20)
    got = maxent_lm.scored_documents(docs).collect()
    texts = [(i, t.encode().lower().split() + [b""], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in texts_of(docs)]
    counts = Counter(w for _, words, out in texts if not out for w in words)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, out, len(w), sum(counts[x] > 0 for x in w), n,
                    round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w, out in texts)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and r["doc_id"] and r["n_tokens"] == 61]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent_lm.scored_documents(none).count() == 0


@pytest.mark.parametrize("known", [3, 40, 1_000])
def test_language_model_is_a_distribution(known):
    """The words after a context, and the unknown word, have probabilities that add up to one."""
    counts = np.arange(known, 0, -1)
    words = maxent_lm.Words([str(i).encode() for i in range(known)], counts)
    trainer = maxent_lm.Trainer(words, None)
    rng = np.random.default_rng(1)
    trainer.add(rng.choice(known, 20_000, p=counts / counts.sum()))
    trainer.flush()
    ids = np.append(np.arange(known), words.rare)
    hashes = np.repeat(maxent_lm.contexts(np.array([1, 2, 0, 1]), words.begin)[-1:], len(ids), axis=0)
    scores = maxent_lm.log10_head(words, trainer.weights, ids, hashes)
    tail = np.append(counts[maxent_lm.HEAD:] + 1, 1)
    scores[ids >= maxent_lm.HEAD] += np.log10(tail / tail.sum())
    assert abs((10 ** scores).sum() - 1) < 1e-4


def test_language_model_learns_every_token():
    """Each token of a text, and its end, is a target: it touches the four rows of its context."""
    words = maxent_lm.Words([str(i).encode() for i in range(50)], np.arange(50, 0, -1))
    trainer = maxent_lm.Trainer(words, None)
    ids = np.arange(5_000) * 7 % 50
    trainer.add(ids)
    trainer.flush()
    assert trainer.touched[:maxent_lm.CLASS_SLOTS].sum() == 4 * len(ids)
    assert trainer.touched[maxent_lm.CLASS_SLOTS:].sum() == 3 * len(ids)


def test_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 2e-200], 0), (2, [1e200, 2e200], 0), (3, [2e200, 4e200], 0), (4, [1.0, -2.0], 0)]
    found = subspace_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()) == [
        (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_mixing_lists_every_pass_of_a_small_source(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 999, "big") for i in range(400)] + [(900, "tiny", "small")],
                                 "doc_id bigint, text string, source string")
    whole = Counter(map(tuple, mixing.mix(docs, {"big": 1, "small": 1}, block_chars=1_000).collect()))
    passes = sorted(r[2] for r in whole if r[0] == 900)
    assert passes == list(range(len(passes))) and len(passes) > 10_000
    monkeypatch.setattr(mixing, "PASSES", 7)
    assert Counter(map(tuple, mixing.mix(docs, {"big": 1, "small": 1}, block_chars=1_000).collect())) == whole


@pytest.mark.parametrize("weights", [
    {"a": 0.61803, "b": 0.3819, "rare": 3e-6}, {"a": 1 / 3, "b": 1 / 7, "c": 0.52, "rare": 1e-5}, None])
def test_mix_keeps_to_the_given_weights(spark, weights):
    """Every slot stays within a block of the exact weights, with a source far below 1/1,000."""
    sources = sorted(weights or "ab")
    rows = [(i, "x" * 99, sources[i % (len(sources) - 1)]) for i in range(9_000)] + [(9_000, "y" * 9, "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    placed = mixing.mix(docs, weights, block_chars=100).collect()
    assert {r["doc_id"] for r in placed if r["pass"] == 0} == set(range(9_001))
    owner = {r["slot"]: r["source"] for r in placed}
    assert sorted(owner) == list(range(len(owner))) and len(owner) < 40_000
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text) + 1
    weights = weights or {s: n ** mixing.POWER for s, n in sizes.items()}
    given = {s: Fraction(w) for s, w in weights.items()}
    assert mixing.deviation([owner[k] for k in range(len(owner))], given) < 1


def test_horizon_keeps_windows_with_many_small_sources():
    parts, first = [1_000, 1_000, *range(1, 11)], [500, 300, *[1] * 10]
    end = mixing.horizon(parts, first)
    had = Counter(mixing.placements(parts, first, end))
    assert all(had[s] >= n for s, n in enumerate(first)) and end == sum(had.values())


def test_toxicity_on_held_out_labels(spark, sf, edges, none):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "river", "stone"]
    rows = []
    for i in range(600):
        words = rng.choice(vocabulary, 40).tolist()
        rows.append((i, " ".join(words + ["vilewretch"] * (i % 5 == 0)), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = table.select("doc_id", "toxic")
    got = {r["doc_id"]: r for r in toxicity.scored_documents(table.drop("toxic"), labels).collect()}
    assert all(got[i]["predicted"] == toxic for i, _, toxic in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    found = toxicity.scored_documents(edges, labels.limit(0)).collect()
    assert len(found) == edges.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.scored_documents(none, labels).count() == 0


def test_toxicity_ratios_match_naive_counts():
    """Code points, whatever their bytes, and both signs."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abé中😀  "), int(rng.integers(0, 30)))) for _ in range(60)]
    labels = [int("é" in t and "b" in t) for t in texts]

    def slots_of(text):
        text = " " + " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), text).split()) + " "
        out = set()
        for n in toxicity.LENGTHS:
            for at in range(len(text) - n + 1):
                value = n
                for c in text[at:at + n]:
                    value = (value * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                out.add((value * 0xD6E8FEB86659FD93 % 2**64) >> 44)
        return out

    every = np.ones(toxicity.SLOTS, bool)
    counts = np.zeros((2, toxicity.SLOTS), np.int64)
    for text, label in zip(texts, labels):
        assert set(toxicity.present(text.encode(), every).tolist()) == slots_of(text)
        counts[label, list(slots_of(text))] += 1
    clean, toxic = labels.count(0), labels.count(1)
    ratio, sigma = toxicity.log_ratios(counts, clean, toxic)
    for slot in np.flatnonzero(counts.sum(axis=0))[:200]:
        want = math.log((counts[1, slot] + 0.5) / (toxic + 1)) - math.log((counts[0, slot] + 0.5) / (clean + 1))
        assert ratio[slot] == pytest.approx(want)
        assert (sigma[slot] > 0) == (counts[:, slot].sum() > 1 and want != 0)
    assert (ratio[sigma > 0] < 0).any() and (ratio[sigma > 0] > 0).any()


def test_clean_and_toxic_words_both_weigh(spark):
    rows = [(f"{'goodword kindly' if i % 2 else 'vilewretch badly'} filler{i % 9} more{i % 7}", 1 - i % 2) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    scores = {r["text"]: r["_score"] for r in toxicity.score(
        spark.createDataFrame([("goodword",), ("vilewretch",), ("neither",)], "text string"), model).collect()}
    assert scores["goodword"] < scores["neither"] < scores["vilewretch"]


def test_secrets_and_false_positives(spark, edges, none):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        number = "".join(rng.choice(list("0123456789"), 16))
        rows.append((i, f'the door token = "{value}" is open {number} and closed', "p"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = secret_scan.scan(docs).collect()
    assert len(got) == 240 and all(r["is_secret"] == (r["length"] == 40) for r in got)
    text = dict(r[:2] for r in rows)
    assert all(hashlib.sha256(text[r["doc_id"]][r["start"]:r["start"] + r["length"]].encode()).hexdigest() == r["value_sha256"] for r in got)
    found = secret_scan.scan(edges)
    assert found.where("doc_id = 11 and length = 40").count() == 1
    assert secret_scan.scan(none).count() == 0


def planted(spark, folder):
    """Clean, toxic, copied and personal documents, nulls, and columns with the stages' own names."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choice(vocabulary, 60).tolist()
        toxic = i % 6 == 0
        rows.append((i, " ".join(words + ["vilewretch scum"] * toxic), "en", f"s{i % 3}"))
        if i >= 30:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1], "en", "s1") for i in range(3)]
    rows += [(2000, "write to jo.doe@mail.example.org " + " ".join(f"own{i}" for i in range(50)), "en", "s2"), (2001, None, None, None), (2001, None, None, None),
             (2002, "", "en", "s0"), (2003, "é " * 30_000, "fr", "s0")]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, _score string, _base string, _all string, _row string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "a", "b", "c", "d") for r in rows], names)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = planted(spark, str(tmp_path))
    texts = {i: t for i, t, *_ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "personal_data", "mix_sources", "pack_sequences"]
    kept = pipeline_stages.reject_toxic(spark, docs, str(tmp_path))
    toxic = {i for i in range(0, 240, 6)}
    assert kept.columns == names and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in toxic)
    single = pipeline_stages.near_dedup(spark, common.staged(kept), str(tmp_path))
    ids = Counter(r["doc_id"] for r in single.collect())
    # Empty texts share the zero fingerprint, so the smallest of their ids stays, twice.
    gone = {1000, 1001, 1002, 2002}
    assert single.columns == names and ids == Counter(i for i, *_ in rows if i not in toxic and i not in gone)
    clean = pipeline_stages.redact_personal_data(spark, common.staged(single), str(tmp_path))
    found = {r["doc_id"]: r for r in clean.collect()}
    assert found[2000]["text"] == texts[2000].replace("jo.doe@mail.example.org", "<EMAIL>")
    assert found[2000]["n_chars"] == len(found[2000]["text"]) and found[2001]["text"] is None
    assert all(r["text"] == texts[i] and tuple(r)[5:] == ("a", "b", "c", "d") for i, r in found.items() if i != 2000)
    mixed = pipeline_stages.mix_sources(spark, common.staged(clean), str(tmp_path))
    placed = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == names and set(placed) == set(ids) and all(placed[i] >= n for i, n in ids.items())
    assert {(r["doc_id"], r["text"], r["_score"]) for r in mixed.collect()} == {(i, r["text"], "a") for i, r in found.items()}
    packed = pipeline_stages.pack_sequences(spark, common.staged(mixed), str(tmp_path)).collect()
    whole = Counter()
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    lengths = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert whole == Counter({i: placed[i] * lengths[i] for i in placed})
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(ids)


def test_pipeline_of_an_empty_table(spark, sf, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_that_are_equal_keep_all_their_places(spark, edges):
    twice = edges.unionByName(edges)
    placed = Counter(r["doc_id"] for r in mixing.mix(twice, block_chars=1000).collect())
    mixed = mixing.mixed_documents(twice)
    assert Counter(r["doc_id"] for r in mixed.collect()).keys() == placed.keys()
    assert mixed.columns == edges.columns and mixed.count() >= 2 * edges.count()
