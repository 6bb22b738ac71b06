"""Operators over documents against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from replyloom.llm import jaccard
from replyloom.llm.block_naming import drop_copies, exact_dedup
from replyloom.llm.components import connected_components
from replyloom.llm.common import Scratch
from replyloom.llm.jaccard import keep_one_per_group, shingle_classes
from replyloom.llm.mixing import mix_amounts, mix_documents, mix_schedule, share_out
from replyloom.llm.packing import Packer, pack_documents
from replyloom.llm.quality import LineRules, clean_documents, judge_text, line_quality, repeated_words

SCHEMA = "doc_id long, text string, source string, key long, name string, block string, token long"


def docs_of(spark, rows):
    """(doc_id, text[, source]) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "n", "b", 9) for r in rows], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "A", "a", "É", "é", "x" * 50, "x" * 51, "ab" * 20, "AB" * 20, " "]
    texts += ["".join(rng.choice("ab") for _ in range(rng.choice((3, 4, 8, 9)))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup(docs_of(spark, rows), block_bytes=3).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[low(t)]
        assert got[i].keep_id == max(own) and got[i].group_size == len(own)
        assert got[i].kept == (i == max(own))
        assert got[i].text_sha256 == hashlib.sha256(low(t).encode()).hexdigest()


def test_exact_dedup_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")]
    got = exact_dedup(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == Counter(
        {(1, True): 1, (1, False): 1, (None, False): 1, (None, True): 1, (2, True): 1})
    assert exact_dedup(docs_of(spark, [])).count() == 0
    kept = drop_copies(docs_of(spark, rows + [(1, "z")]))
    assert kept.columns == docs_of(spark, []).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, "a"), (None, "b"), (2, "c"), (1, "z")])


def test_a_hash_that_two_blocks_share_is_noticed(spark, monkeypatch):
    from replyloom.llm import block_naming
    from pyspark import cloudpickle

    real = block_naming._key

    def weak(block, seed):
        return real(block, seed) if seed else len(block)

    monkeypatch.setattr(block_naming, "_key", weak)
    cloudpickle.register_pickle_by_value(block_naming)
    try:
        got = {r.doc_id: r.group_size for r in
               exact_dedup(docs_of(spark, [(1, "ab"), (2, "cd"), (3, "AB")])).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(block_naming)
    assert got == {1: 2, 2: 1, 3: 2}


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:  # shingles as tuples of words, not hashes
        words = low(t).encode().split()
        width = min(size, len(words))
        sets[i] = {(width, *words[k:k + width]) for k in range(len(words) - width + 1)} if width else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in rows if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i, _ in rows}


def near_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for family in range(n // 12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 12, 60)))]
        for _ in range(12):
            words = base[:]
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += passage
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)))
    return rows + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one"), (10_004, "ONE")]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components_against_brute_force(spark, size, percent):
    rows = near_rows(size, 240)
    expected = brute_components(rows, size, percent)
    got = shingle_classes(docs_of(spark, rows), size=size, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected


def test_jaccard_edge_cases(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (3, None), (None, ""), (7, "q r s t u")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id)
                  for r in shingle_classes(docs_of(spark, rows)).collect())
    assert got == Counter({(5, 5, 5): 2, (None, 5, 5): 1, (3, 0, 3): 1, (None, 0, None): 1,
                           (7, 2, 7): 1})
    assert shingle_classes(docs_of(spark, [])).count() == 0
    kept = keep_one_per_group(docs_of(spark, [(1, text), (2, text), (3, None), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_one_row_of_each_group_stays_when_ids_repeat_or_are_null(spark):
    near = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(3, near), (5, other), (5, near + " z"), (7, near + " y"), (7, near + " x")]
    kept = keep_one_per_group(docs_of(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, near), (5, other)]
    rows = [(3, near), (3, near), (3, near + " y"), (None, near), (None, other)]
    kept = keep_one_per_group(docs_of(spark, rows)).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {3, None}
    assert keep_one_per_group(docs_of(spark, [])).count() == 0


def test_prefix_order_follows_the_counts_of_the_whole_table(spark):
    """Tokens that only one document has make no postings, however small the counted ranges."""
    sent = [jaccard._slice_tokens(frame, 1, bits) for bits in (0, 3) for frame in [pd.DataFrame(
        {"slice": [8, 8], "text": ["a b c c", "b"]})]]
    for frame in sent:
        counted = jaccard._count_range(frame) if len(frame["range"].unique()) == 1 else pd.concat(
            jaccard._count_range(g) for _, g in frame.groupby("range"))
        codes = b"".join(counted.sort_values("range")["codes"])
        tokens, counts = jaccard._distinct_tokens(jaccard._tokens_of(
            pd.DataFrame({"text": ["a b c c", "b"]}), 1))
        assert list(codes) == counts.tolist() and sorted(codes) == [1, 1, 2]
    counts = np.array([1, 2, 127, 128, 300, 10 ** 6, 10 ** 12])
    decoded = jaccard.COUNT_OF[jaccard._codes(counts)]
    assert (np.diff(decoded) > 0).all() and (decoded[:3] == counts[:3]).all()
    assert (np.abs(decoded[3:6] / counts[3:6] - 1.1) < 0.11).all()


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (200, 200)]
    scratch = Scratch(spark, "test")
    got = connected_components(scratch, spark.createDataFrame(links, "a long, b long"))
    roots = {r.node: r.root for r in got.collect()}
    scratch.drop()
    assert roots == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def brute_quality(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1
               for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
            "n_repeat_words": len(covered),
            "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "c#", "|", "\n", "\t", "\x0b", " ", "dd", " "]),
                max_size=160))
def test_quality_counts_against_brute_force(parts):
    text = " ".join(parts)
    got, _ = judge_text(text.encode(), LineRules())
    for name, value in brute_quality(text).items():
        assert got[name] == value, name


def test_repeated_words_with_many_distinct_words():
    words = [str(i).encode() for i in range(2_100_000)]
    assert repeated_words(words + words[:3]) == 6


def test_quality_rejects_junk_and_keeps_prose(spark):
    prose = "\n".join(f"Line{i} tells{i} of{i} a{i} thing{i}, and{i} ends{i}." for i in range(12))
    menu = "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(12))
    shout = "\n".join(" ".join(f"WORD{i}{j}!!" for j in range(12)) for i in range(12))
    mixed = prose + "\nAll rights reserved. Terms of use apply.\n" + " | ".join("abcdefgh")
    rows = [(1, prose), (2, menu), (3, shout), (4, mixed), (5, None), (6, ""), (7, "x " * 3000)]
    got = {r.doc_id: r for r in line_quality(docs_of(spark, rows), with_text=True).collect()}
    assert [i for i in got if got[i].kept] == [1, 4]
    assert got[4].clean_text == prose and got[1].clean_text == prose
    assert got[5].n_words == 0 and got[5].base_failed
    clean = clean_documents(docs_of(spark, rows).withColumn("n_chars", F.length("text").cast("long")))
    assert {(r.doc_id, r.n_chars) for r in clean.collect()} == {(1, len(prose)), (4, len(prose))}
    assert line_quality(docs_of(spark, [])).count() == 0


def test_shares_are_capped_and_reshared():
    sizes = [100, 1000, 10, 0]
    target = share_out(sizes, [5, 2, 1, 5], sum(sizes))
    assert target[3] == 0 and abs(sum(target) - sum(sizes)) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in zip(target, sizes))
    assert target[0] == 300 and target[2] == 30


def mix_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(rng.choice((0, 1, 7, 40, 300)))), source))
    return rows


def test_mix_reaches_targets_and_agrees_on_reruns(spark):
    rows = mix_rows()
    docs = docs_of(spark, rows)
    got = mix_amounts(docs, block_words=16).collect()
    assert len(got) == len(rows)
    sizes = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    by_source = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken <= 3 * r.size
        one = by_source[source[r.doc_id]]
        one[0] += r.taken
        one[1], one[2] = r.target, r.source_size
    order = sorted((s for s in by_source if s is not None)) + [None]
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in order}
    weights = [(5, 2, 1)[k % 3] for k in range(len(order))]
    targets = share_out([total[s] for s in order], weights, sum(total.values()))
    for s, target in zip(order, targets):
        assert by_source[s][2] == total[s]
        assert abs(by_source[s][1] - target) < 1e-6 and abs(by_source[s][0] - target) <= 0.5
    again = mix_amounts(docs.repartition(7), block_words=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_schedule_spreads_sources_and_covers_blocks(spark):
    rows = mix_rows()
    docs = docs_of(spark, rows)
    pieces = mix_schedule(docs, block_words=16).collect()
    taken = {r.doc_id: r.taken for r in mix_amounts(docs, block_words=16).collect()}
    sums, seen = Counter(), Counter()
    for p in pieces:
        sums[p.doc_id] += p.words
        seen[(p.doc_id, p.epoch, p.first_word)] += 1
    assert {i: n for i, n in taken.items() if n} == dict(sums)
    assert max(seen.values()) == 1
    # In every stretch of the mix a source has nearly its share.
    source = {i: s for i, _, s in rows}
    last = max(p.slot for p in pieces)
    whole = Counter()
    early = Counter()
    for p in pieces:
        whole[source[p.doc_id]] += p.words
        early[source[p.doc_id]] += p.words if p.slot <= last // 2 else 0
    for s, n in whole.items():
        assert abs(early[s] - n / 2) <= 16 * 8 + 0.05 * n


def test_mixed_documents_repeat_and_cut_texts(spark):
    rows = mix_rows() + [(0, "a b", "a"), (0, "a b", "a"), (None, "p q r", "b"), (9_999, None, None)]
    docs = docs_of(spark, rows)
    amounts = Counter()
    for r in mix_amounts(docs).collect():
        amounts[r.doc_id] += r.taken
    got = Counter()
    for r in mix_documents(docs).collect():
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({i: n for i, n in amounts.items() if n})
    assert mix_documents(docs).columns == docs.columns
    assert mix_amounts(docs_of(spark, [])).count() == 0
    assert mix_documents(docs_of(spark, [(1, None), (2, "")])).count() == 0


def brute_place(sizes, capacity, max_per_source):
    bins, out = [], []
    for size, source, cluster in sizes:
        fits = [b for b in bins if b["left"] >= size and cluster not in b["clusters"]
                and b["sources"][source] < max_per_source]
        best = min(fits, key=lambda b: (b["left"], b["number"]), default=None)
        if best is None:
            best = {"left": capacity, "clusters": set(), "sources": Counter(), "number": len(bins)}
            bins.append(best)
        out.append((best["number"], capacity - best["left"]))
        best["left"] -= size
        best["clusters"].add(cluster)
        best["sources"][source] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from("abc"), st.integers(0, 6)), max_size=60),
       st.integers(1, 3))
def test_best_fit_against_brute_force(pieces, per_source):
    packer = Packer(20, per_source)
    assert [packer.place(*p) for p in pieces] == brute_place(pieces, 20, per_source)


def test_packing_of_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice((1, 5, 30, 64, 65, 200))) + f" {i % 50}",
             "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(300)]
    rows += [(300, None), (301, ""), (None, "a b c", None), (5, rows[5][1], rows[5][2])]
    got = pack_documents(docs_of(spark, rows), capacity=64, group_pieces=100).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_words
    expected = Counter()
    for i, t, *_ in rows:
        expected[i] += len((t or "").split())
    assert words == expected
    source = {i: r[0] if r else "s" for i, _, *r in rows}
    text = {i: low(t) for i, t, *_ in rows}
    bins = defaultdict(list)
    for r in got:
        if r.n_words:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    for rows_in in bins.values():
        rows_in.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in rows_in:
            assert r.bin_offset == end
            end += r.n_words
        assert end <= 64
        assert max(Counter(text[r.doc_id] for r in rows_in).values()) == 1
        assert max(Counter(source[r.doc_id] for r in rows_in).values()) <= 4
    assert pack_documents(docs_of(spark, [])).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        assert rows
        if name == "quality":
            good = {r.doc_id for r in line_quality(docs).filter("kept").collect()}
            assert {r.doc_id for r in rows} == good
        elif name == "exact_dedup":
            assert Counter(low(r.text) for r in rows).most_common(1)[0][1] == 1
            assert {low(r.text) for r in rows} == {low(r.text) for r in docs.collect()}
        elif name == "near_dedup":
            expected = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in rows} == {root for _, root in expected.values()}
        elif name == "mix":
            amounts = {r.doc_id: r.taken for r in mix_amounts(docs).collect()}
            got = Counter()
            for r in rows:
                got[r.doc_id] += len(r.text.split())
            assert got == Counter({i: n for i, n in amounts.items() if n})
        else:
            assert sum(r.n_words for r in rows) == sum(len(r.text.split()) for r in docs.collect())
        if name != "pack":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)


FULL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)) + "."


def test_stages_tell_rows_apart_by_more_than_their_ids(spark):
    one, two = prose(1), prose(2)
    rows = [(1, one, "en", "s", 1), (1, two, "en", None, 1), (1, one, "en", "s", 1),
            (None, one.upper(), "en", "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, FULL)
    kept = drop_copies(docs).collect()
    assert sorted(str(r.text) for r in kept if r.text) == sorted([one, two])
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, None}  # null and empty are one text
    clean = clean_documents(docs).collect()
    assert sorted(r.text for r in clean) == sorted([one, one, two, one.upper()])
    assert all(r.n_chars == len(r.text) for r in clean)
    mixed = mix_documents(docs).collect()
    assert mixed and {r.text for r in mixed} <= {one, two, one.upper()} | {
        t[:t.rindex(" ", 0, i)] for t in (one, two, one.upper()) for i in range(3, len(t)) if " " in t[:i]}
    for stage in (drop_copies, clean_documents, mix_documents, keep_one_per_group):
        empty = stage(docs.limit(0))
        assert empty.count() == 0 and empty.columns == docs.columns
    assert pack_documents(docs.limit(0)).count() == 0


def test_pipeline_on_repeated_and_missing_ids(spark, tmp_path):
    texts = [prose(i) for i in range(6)]
    near = texts[0] + " z1 z2"
    rows = [(i % 3 if i else None, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(7, texts[1], "en", "s1", 1), (7, near, "en", "s1", 1), (7, None, "en", "s1", 1)]
    spark.createDataFrame(rows, FULL).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of equal texts the row with the largest id stays, of near ones that with the smallest.
    assert {r.doc_id for r in out} == {0, 1, 2, 7}
    nothing = tmp_path / "none"
    spark.createDataFrame([], FULL).write.parquet(str(nothing / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0
