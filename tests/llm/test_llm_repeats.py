"""Repeated passages against brute force over all windows, and edge cases."""

import hashlib
import random

import numpy as np
import pytest

from replyloom.llm import repeats
from replyloom.llm.repeats import find_runs, remove_repeats

SCHEMA = ("doc_id long, text string, key long, node long, run long, anchor string, digit string, "
          "row_id long, first_row long")


def docs_of(spark, rows):
    """(doc_id, text) rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "a", "d", 4, 5) for i, t in rows], SCHEMA)


def brute_force(rows, window):
    """Removed spans and kept bytes, rows in the order of their ids."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - window + 1):
            part = data[at:at + window]
            if part in seen:
                gone[at:at + window] = True
            seen.add(part)
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), spans, kept))
    return out


def check(spark, rows, window, anchor, parts=5):
    got = sorted(remove_repeats(docs_of(spark, rows).repartition(parts), window=window,
                                anchor=anchor, with_text=True).collect(), key=lambda r: r.doc_id)
    want = brute_force(rows, window)
    assert len(got) == len(want)
    for r, (n_bytes, spans, kept) in zip(got, want):
        assert [(s.start, s.end) for s in r.spans] == spans, (r.doc_id, spans)
        assert bytes(r.kept) == kept and r.n_bytes == n_bytes
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert (r.n_removed, r.n_spans) == (n_bytes - len(kept), len(spans))


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "größe", "delta", "e", "zeta", "naïve", "theta-iota", "日本"]
    passages = [words(rng, 14, vocabulary) for _ in range(4)]
    texts = [None, "", "a" * 250, "ab" * 120, "a" * 99, "a" * 100, "x" + "a" * 130 + "y"]
    for _ in range(40):
        parts = [words(rng, rng.randrange(1, 25), vocabulary + [str(rng.random())])
                 for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += rng.sample(texts, 12)                                    # copies
    texts += [t[:60] + "#" + t[61:] for t in rng.sample(texts[7:], 8)]  # near copies
    texts += [p + p + p for p in passages]                            # repeats inside a text
    ids = rng.sample(range(1000), len(texts))
    check(spark, list(zip(ids, texts)), 100, 36)


@pytest.mark.parametrize("window, anchor", [(20, 12), (40, 8), (17, 9)])
def test_repeats_with_other_windows(spark, window, anchor):
    rng = random.Random(window)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((5, 60, 200)))) for _ in range(30)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(10)]
    texts += [t + u for t, u in zip(texts, texts[3:])]
    check(spark, list(enumerate(texts)), window, anchor)


def test_texts_longer_than_a_segment(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = ["x" * 37 + base, base, base[700:] + base[:700], "q" + base[100:900]]
    want = {bytes(w) for t in texts for w in ([t[i:i + 100].encode() for i in
                                               range(len(t) - 99)])}
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    found = set()
    data = [t.encode() for t in texts]
    for runs in find_runs(data, 100, 36):
        for i, a, b, at in zip(runs.text, runs.first, runs.last, runs.at):
            assert a <= at <= a + 64 and b <= at <= b + 64
            found |= {data[i][p:p + 100] for p in range(a, b + 1)}
    assert found == want
    # Workers cut at the real size; a text over it is checked through equal halves.
    monkeypatch.undo()
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(repeats.SEGMENT + 5000))
    got = {r.doc_id: r for r in remove_repeats(
        docs_of(spark, [(1, long), (2, "zz" + long + "yy"), (3, long[1000:3000])])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, len(long), 1)
    assert (got[3].n_removed, got[3].n_spans) == (2000, 1)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    got = remove_repeats(docs_of(spark, [(5, text), (5, text), (None, text), (7, text + "!")]))
    assert sorted((str(r.doc_id), r.n_removed) for r in got.collect()) == sorted(
        [("5", 0), ("5", len(text)), ("None", len(text)), ("7", len(text))])
    got = remove_repeats(docs_of(spark, [(None, text), (3, text)])).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, len(text)), (3, 0)}
    assert remove_repeats(docs_of(spark, [])).count() == 0
    assert [r.n_spans for r in remove_repeats(docs_of(spark, [(1, None)])).collect()] == [0]
    with pytest.raises(ValueError):
        remove_repeats(docs_of(spark, []), window=10, anchor=9)
