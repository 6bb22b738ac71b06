"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

The tokens of a document are the 64-bit hashes of its distinct word shingles. All documents sort
their tokens by one order, rare ones first. Two sets that reach the threshold share at least ``l``
tokens among their first ``n - ceil(t*n) + l`` ones, for every ``l``. Each document chooses its own
``l``: a longer prefix costs postings but asks for more shared tokens before anything is verified;
the choice minimises the estimate made from corpus counts (Wang, Li and Feng, 2012). A pair must
share ``min(l1, l2)`` prefix tokens.

The output is one component id per document, so a posting list is never expanded into all its
pairs. Documents with equal sets are one class from the start. Then every posting list links its
documents to one hub, the document with the fewest tokens of its own, which is the most central one.
Verified links merge documents into components, hubs are chosen anew while long lists still hold
several components, and at the end each list emits the pairs that lie in different components and
were not verified before. Those are exactly the pairs that can still change the result.

Document counts come from all tokens of all documents. Tokens that occur in one slice of documents
travel together, as sorted arrays of 32-bit marks within ranges of the hashes; each range is counted
by one task and every slice gets back one byte a token: the count, exact up to 127 and in quarter
octaves above. Two tokens with one mark count as one, which can only make both look more frequent.
A token that is alone in the corpus never becomes a posting.

What is exact: sizes, thresholds and verification, over whole texts and all documents. Sets are sets
of 64-bit hashes: two different shingles of one corpus of m distinct ones share a hash with
probability of about m**2 / 2**65, and that changes one overlap by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import SLICE_ROWS, Scratch
from replyloom.llm.components import connected_components
from replyloom.llm.shingles import shingle_sets
from replyloom.operators.keys import lookup_join

#: Documents whose tokens are sent for counting together, as a power of two.
SLICE_BITS = 8
#: Bytes of text whose tokens one task counts.
RANGE_BYTES = 1 << 24
#: Partners of one document that one task verifies together.
PARTNERS = 2000
#: Words of the bitmap of a prefix: each token sets one of its bits.
WORDS = ("w0", "w1", "w2", "w3")
#: Choices of ``l``.
MAX_MATCHES = 8
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 20.0
#: Rounds of new hubs go on while they find links and open pairs exceed this many per document.
PAIRS_PER_DOC = 20.0
MAX_HUB_ROUNDS = 4


def _needed(n: int, percent: int) -> int:
    """Smallest overlap that a set of size ``n`` needs with any partner."""
    return -(-percent * n // 100)


#: Document count that each code stands for.
COUNT_OF = np.concatenate([np.arange(128), 127 * 2.0 ** (np.arange(1, 129) / 4)])


def _codes(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(COUNT_OF, np.minimum(counts, COUNT_OF[-1])).astype(np.uint8)


def _tokens_of(frame: pd.DataFrame, size: int) -> list[np.ndarray]:
    return list(shingle_sets([(t or "").encode() for t in frame["text"]], size))


def _distinct_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)


def _slice_tokens(frame: pd.DataFrame, size: int, bits: int) -> pd.DataFrame:
    """The distinct tokens of some documents of one slice, a row for each range of hashes; there
    are ``2**bits`` ranges."""
    if not len(frame):
        return pd.DataFrame({c: pd.Series(dtype=object)
                             for c in ("slice", "range", "marks", "counts")})
    tokens, counts = _distinct_tokens(_tokens_of(frame, size))
    ranges = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(
        len(tokens), np.int64)
    marks = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    counts = np.minimum(counts, 65535).astype(np.uint16)
    found, starts = np.unique(ranges, return_index=True)
    cuts = [*starts.tolist(), len(tokens)]
    return pd.DataFrame({
        "slice": [frame["slice"].iat[0]] * len(found), "range": found,
        "marks": [marks[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
        "counts": [counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})


def _count_range(frame: pd.DataFrame) -> pd.DataFrame:
    """For every slice the codes of its tokens in one range."""
    parts = [np.frombuffer(m, np.uint32) for m in frame["marks"]]
    counts = np.concatenate([np.frombuffer(c, np.uint16) for c in frame["counts"]])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    codes = _codes(np.bincount(which, weights=counts)[which])
    cuts = np.cumsum([0, *map(len, parts)])
    return pd.DataFrame({"slice": frame["slice"], "range": frame["range"],
                         "codes": [codes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})


def _choose(tokens: np.ndarray, df: np.ndarray, percent: int) -> int:
    """The number of matches with the lowest estimated cost; ``df`` is in prefix order."""
    n = len(tokens)
    base = n - _needed(n, percent)
    most = min(MAX_MATCHES, _needed(n, percent))
    lists = np.cumsum(df[:base + most])
    matches = np.arange(1, most + 1)
    postings = lists[base:base + most]
    # At most postings / l documents can share l tokens of the prefix.
    cost = postings + VERIFY_COST * (postings - (base + matches)) / matches
    return int(matches[np.argmin(cost)])


def _sets(frames: Iterable[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Size and digest of the set of every row."""
    for frame in frames:
        for start in range(0, len(frame), SLICE_ROWS):
            part = frame.iloc[start:start + SLICE_ROWS]
            sets = _tokens_of(part, size)
            yield pd.DataFrame({
                "row": part["row"], "id": part["id"], "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]})


def _prefixes(frame: pd.DataFrame, answers: pd.DataFrame, size: int,
              percent: int) -> pd.DataFrame:
    """Choice of ``l`` and prefix of some documents of one slice.

    Of the prefix only tokens that other sets have are given, with their place among those of the
    document: ``n_own`` tokens that no other set has come before all others and count for nothing.
    """
    sets = _tokens_of(frame, size)
    known, _ = _distinct_tokens(sets)
    codes = np.frombuffer(b"".join(answers.sort_values("range")["codes"]), np.uint8)
    if len(codes) != len(known):
        raise RuntimeError("the counts do not belong to the tokens of this slice")
    rows: dict[str, list] = {k: [] for k in ("l", "n_own", "prefix", "places", *WORDS)}
    for tokens in sets:
        n = len(tokens)
        code = codes[np.searchsorted(known, tokens)]
        order = np.argsort(code, kind="stable")
        tokens, code = tokens[order], code[order]
        matches = _choose(tokens, COUNT_OF[code], percent)
        own = int((code == 1).sum())
        stop = max(own, n - _needed(n, percent) + matches)
        rows["l"].append(matches)
        rows["n_own"].append(own)
        rows["prefix"].append(tokens[own:stop].view(np.int64))
        rows["places"].append(np.arange(stop - own, dtype=np.int32))
        bits = np.zeros(64 * len(WORDS), np.uint8)
        bits[(tokens[own:stop] >> np.uint64(20)) % np.uint64(len(bits))] = 1
        for word, value in zip(WORDS, np.packbits(bits).view(np.int64).tolist()):
            rows[word].append(value)
    # Without rows pandas would take the lists for numbers.
    return pd.DataFrame({"row": frame["row"].to_numpy(), **{
        name: pd.Series(values, dtype=object if name in ("prefix", "places") else np.int64)
        for name, values in rows.items()}})


def _linked(frames: Iterable[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs of texts with the verdict; neighbouring rows mostly share the first text."""
    for pairs in frames:
        verdicts: list[bool] = []
        for start in range(0, len(pairs), SLICE_ROWS):
            part = pairs.iloc[start:start + SLICE_ROWS]
            ours = list(dict.fromkeys(part["text_a"]))
            sets = dict(zip(ours, shingle_sets([t.encode() for t in ours], size)))
            others = shingle_sets([t.encode() for t in part["text_b"]], size)
            for text_a, other in zip(part["text_a"], others):
                mine = sets[text_a]
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                shared = int((mine[at] == other).sum())
                verdicts.append(100 * shared >= percent * (len(mine) + len(other) - shared))
        yield pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "linked": verdicts})


@dataclass(frozen=True)
class _Texts:
    """Texts bucketed by ``row``, and the ``row`` whose text stands for every node."""

    table: DataFrame
    keys: DataFrame

    def of(self, nodes: DataFrame, node: str, name: str) -> DataFrame:
        """``nodes`` with the text of their column ``node``; narrow rows go to the buckets."""
        keyed = nodes.join(self.keys.withColumnRenamed("node", node), node)
        return keyed.join(self.table.withColumnRenamed("text", name), "row").drop("row")


def _verify(scratch: Scratch, pairs: DataFrame, texts: _Texts, size: int,
            percent: int) -> DataFrame:
    """``a, b, linked`` of candidate pairs.

    Texts travel, not sets: they are smaller. A first document with many partners is a hot key;
    its partners are dealt to groups of bounded size, each with a copy of its text.
    """
    pairs = scratch.write(pairs, "pairs")
    groups = pairs.groupBy("a").agg(
        F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("groups"))
    firsts = texts.of(groups, "a", "text_a").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    dealt = pairs.join(groups, "a").select(
        "a", "b", F.pmod(F.hash("b"), F.col("groups")).alias("part"))
    met = texts.of(dealt, "b", "text_b").join(firsts, ["a", "part"])
    return scratch.write(met.select("a", "b", "text_a", "text_b").mapInPandas(
        lambda it: _linked(it, size, percent), "a long, b long, linked boolean"), "verified")


def _with_roots(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return postings.withColumn("root", F.col("node"))
    return postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open_lists(rooted: DataFrame, turn: int = 0) -> DataFrame:
    """Posting lists that still hold more than one component, with their hub.

    The first hub is the document with the fewest tokens of its own; later turns take any other.
    """
    first = (F.col("n") - F.col("n_shared")) if turn == 0 else F.xxhash64("node", F.lit(turn))
    lists = rooted.groupBy("token").agg(
        F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("df"),
        F.min(F.struct(first.alias("rank"), "node", *_OF, "root")).alias("hub"))
    return lists.filter("r1 <> r2")


def _overlap(n: str, m: str, percent: int) -> str:
    """Smallest overlap of linked sets of ``n`` and ``m`` tokens."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


#: What a posting says of its document besides the token: size, number of tokens that other sets
#: have, the token's place among these, matches asked for, listed tokens of the prefix, their bitmap.
_OF = ("n", "n_shared", "pos", "l", "listed", *WORDS)


def _can_link(a: str, b: str, percent: int) -> str:
    """Whether two sets that share a token can link. ``a`` and ``b`` are templates of the columns
    ``_OF`` of their postings.

    Before the shared token at most the smaller of both places is common, behind it what is left.
    And a bit that only one bitmap has stands for a prefix token that the other has not: what
    remains bounds the shared prefix tokens, which have to be ``min(l1, l2)``, and with all tokens
    behind the prefix that ends first, the overlap.
    """
    n, m = a.format("n"), b.format("n")
    sizes = f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"
    places = (f"least({a.format('pos')}, {b.format('pos')}) + least("
              f"{a.format('n_shared')} - {a.format('pos')}, {b.format('n_shared')} - {b.format('pos')}"
              f") >= {_overlap(n, m, percent)}")

    def only(x: str, y: str) -> str:
        return f"{x.format('listed')} - " + " - ".join(
            f"bit_count({x.format(w)} & ~{y.format(w)})" for w in WORDS)

    shared = f"least({only(a, b)}, {only(b, a)})"
    return (f"{sizes} AND {places} AND {shared} >= least({a.format('l')}, {b.format('l')}) AND "
            f"{shared} + {_behind(a, b, percent)} >= {_overlap(n, m, percent)}")


def _behind(a: str, b: str, percent: int) -> str:
    """Most tokens behind the prefix of either set."""
    return "greatest(" + ", ".join(
        f"({percent} * {x.format('n')} + 99) div 100 - {x.format('l')}" for x in (a, b)) + ")"


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles`` and ``component_id``.

    Two documents link when their shingle sets have a Jaccard similarity of ``percent`` / 100 or
    more; ``component_id`` is the smallest id reachable by links, its own included. A text of
    fewer than ``size`` words is one shingle; null, empty and blank texts have none and link with
    nothing. Repeated rows come back repeated; rows that share an id are joined by their texts
    alone. A null id links as any other and never is the smallest, so the component is null only
    if all its ids are. Ids are integers or are cast to them. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    try:
        source = _numbered(scratch, docs.select(F.col(id_col).cast("long").alias("id"),
                                                F.col(text_col).alias("text")))
        return scratch.finish(_classes(scratch, source, size, percent).select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
            .alias("component_id")))
    except BaseException:
        scratch.drop()
        raise


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """A copy of ``docs`` with ``row``, a number of its own for each row, and ``slice``.

    The number is fixed by the copy. Neighbouring rows form a slice, and a slice is in one bucket,
    so a task writes no more files than it has slices.
    """
    return scratch.write_bucketed(
        docs.withColumn("row", F.monotonically_increasing_id())
        .withColumn("slice", F.shiftright("row", SLICE_BITS)), "slice")


def _chosen(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    return frame[frame["row"].astype(str).isin(own["rep"].dropna())]


def _with_prefixes(scratch: Scratch, source: DataFrame, reps: DataFrame, size: int,
                   percent: int) -> DataFrame:
    """Prefixes of the rows ``reps``, by the counts of the tokens of these rows.

    Equal sets are represented by one row, so that copies do not make a token look shared.
    """
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (n_bytes // RANGE_BYTES).bit_length())
    texts = source.select("slice", "row", "text")
    sent = texts.groupBy("slice").cogroup(reps.groupBy("slice")).applyInPandas(
        lambda frame, own: _slice_tokens(_chosen(frame, own), size, bits),
        "slice long, range long, marks binary, counts binary")
    answers = scratch.write(
        sent.groupBy("range").applyInPandas(
            _count_range, "slice long, range long, codes binary"), "codes")
    none = F.lit(None)
    beside = answers.withColumn("rep", none.cast("string")).unionByName(
        reps.select("slice", none.cast("long").alias("range"), none.cast("binary").alias("codes"),
                    "rep"))

    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return _prefixes(_chosen(frame, own), own[own["range"].notna()], size, percent)

    prefixes = scratch.write(
        texts.groupBy("slice").cogroup(beside.groupBy("slice")).applyInPandas(
            run, "row long, l int, n_own int, prefix array<long>, places array<int>, "
            + ", ".join(f"{w} long" for w in WORDS)), "prefixes")
    scratch.forget(answers)
    return prefixes


def _classes(scratch: Scratch, source: DataFrame, size: int, percent: int) -> DataFrame:
    """``row, id, n`` and ``first`` (``no_id, id, row``) of the row's component; null if the row
    has no tokens."""
    # Nullable numbers as strings, since pandas turns integers with nulls into floats.
    rows = scratch.write(
        source.select("row", F.col("id").cast("string").alias("id"), "text").mapInPandas(
            lambda it: _sets(it, size), "row long, id string, n long, digest binary")
        .withColumn("id", F.col("id").cast("long")), "sets")
    # One node for each distinct set; one of its rows lends it the prefix and the text.
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = scratch.write(
        rows.filter("n > 0").groupBy("n", "digest").agg(
            F.min(place).alias("first"), F.min("row").alias("row"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    own = classes.select("node", "row")
    reps = classes.select(F.shiftright("row", SLICE_BITS).alias("slice"),
                          F.col("row").cast("string").alias("rep"))
    prefixes = _with_prefixes(scratch, source, reps, size, percent)
    of_node = prefixes.join(classes.select("node", "n", "row"), "row").select(
        "node", "n", (F.col("n") - F.col("n_own")).cast("int").alias("n_shared"), "l",
        F.size("prefix").alias("listed"), *WORDS,
        F.explode(F.arrays_zip("prefix", "places")).alias("at"))
    pairs = of_node.select(F.col("at.prefix").alias("token"), "node",
                           F.col("at.places").alias("pos"), *[c for c in _OF if c != "pos"])
    lists = scratch.write(
        pairs.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"),
        "lists")
    postings = scratch.write(pairs.join(lists, "token"), "postings")
    scratch.forget(prefixes, lists)

    wanted = scratch.write(
        own.join(postings.select("node").distinct(), "node", "left_semi").groupBy(
            F.shiftright("row", SLICE_BITS).alias("slice")).agg(F.collect_list("row").alias("rows")),
        "wanted")
    # By slice, as the source is bucketed, so that texts that no step needs are not shuffled; then
    # bucketed by the row, so that no later step shuffles any.
    texts = scratch.write_bucketed(
        source.select("slice", "row", "text").join(wanted, "slice")
        .filter(F.array_contains("rows", F.col("row"))).select("row", "text")
        .dropDuplicates(["row"]), "row")
    texts = _Texts(texts, own)
    verified = roots = None
    n_nodes = classes.count()
    for turn in range(MAX_HUB_ROUNDS):
        rooted = _with_roots(postings, roots)
        # Written, so that the join to it can split the list that a third of all rows are in.
        hubs = scratch.write(_open_lists(rooted, turn).select("token", "hub"), "hubs")
        stars = (rooted.join(hubs, "token").filter("root <> hub.root")
                 .filter(_can_link("{}", "hub.{}", percent))
                 .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
        if verified is not None:
            stars = _not_yet(stars, verified)
        found = _verify(scratch, stars, texts, size, percent)
        verified = found if verified is None else verified.unionByName(found)
        before, roots = roots, _merged(scratch, roots, found)
        scratch.forget(hubs)
        if roots is before or _pairs_left(postings, roots) <= PAIRS_PER_DOC * n_nodes:
            break
    rest = _verify(scratch, _remaining(scratch, postings, roots, verified, percent), texts, size,
                   percent)
    roots = _merged(scratch, roots, rest)
    if roots is None:
        roots = own.select("node", F.col("node").alias("root")).limit(0)
    placed = classes.select("node", "n", "digest", "first").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy(F.col("root").alias("of_root")).agg(F.min("first").alias("first"))
    of_class = scratch.write(
        lookup_join(placed.drop("first"), least, "root", "of_root").select(
            F.col("n").alias("class_n"), F.col("digest").alias("class_digest"), "first"),
        "components")
    return rows.select("row", "id", "n", "digest").join(
        of_class, (F.col("n") == F.col("class_n")) & (F.col("digest") == F.col("class_digest")),
        "left").select("row", "id", "n", "first")


def _merged(scratch: Scratch, roots: DataFrame | None, verified: DataFrame) -> DataFrame | None:
    """Components after more verified links; the same object if there are none."""
    new = verified.filter("linked").select("a", "b")
    if not new.limit(1).count():
        return roots
    if roots is not None:
        new = new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return scratch.write(connected_components(scratch, new), "roots")


def _pairs_left(postings: DataFrame, roots: DataFrame) -> float:
    """Upper bound of the pairs of documents in one list and different components."""
    shares = _with_roots(postings, roots).groupBy("token", "root").agg(F.count("*").alias("c"))
    return shares.groupBy("token").agg(
        ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")
    ).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def _not_yet(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    done = verified.select(F.least("a", "b").alias("da"), F.greatest("a", "b").alias("db"))
    return pairs.join(done, (F.least("a", "b") == F.col("da"))
                      & (F.greatest("a", "b") == F.col("db")), "left_anti")


def _remaining(scratch: Scratch, postings: DataFrame, roots: DataFrame, verified: DataFrame,
               percent: int) -> DataFrame:
    """Pairs in different components that share enough prefix tokens and were not verified.

    Besides ``min(l1, l2)``, the shared tokens have to leave the required overlap within reach: of
    the set whose prefix ends first, all common tokens up to that end are shared prefix tokens,
    and only the tokens behind it can add to them.
    """
    rooted = _with_roots(postings, roots)
    still = scratch.write(
        rooted.join(_open_lists(rooted).select("token"), "token", "left_semi"), "still")
    fields = F.struct(*_OF, "root")
    left = still.select("token", F.col("node").alias("a"), fields.alias("x"))
    right = still.select("token", F.col("node").alias("b"), fields.alias("y"))
    pairs = (left.join(right, "token").filter("a < b and x.root <> y.root")
             .filter(_can_link("x.{}", "y.{}", percent))
             .groupBy("a", "b").agg(
                 F.count("*").alias("shared"), F.min(F.least("x.l", "y.l")).alias("asked"),
                 F.min(F.expr(_overlap("x.n", "y.n", percent))).alias("overlap"),
                 F.max(F.expr(_behind("x.{}", "y.{}", percent))).alias("behind"))
             .filter("shared >= asked and shared + behind >= overlap").select("a", "b"))
    return _not_yet(pairs, verified)


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row with the smallest id stays.

    Rows are told apart by a number of their own, not by their ids: rows that share an id are one
    group only if their texts link, and of a group whose smallest id is repeated one row stays.
    Null ids come last. Documents without words are no duplicates of anything and stay. Columns
    are unchanged, whatever their names; an empty table gives an empty one.
    """
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    scratch = Scratch(docs.sparkSession, "near-dedup")
    try:
        table = _numbered(scratch, docs.toDF(*at.values()))
        source = table.select("slice", "row", F.col(at[id_col]).cast("long").alias("id"),
                              F.col(at[text_col]).alias("text"))
        gone = scratch.write(
            _classes(scratch, source, size, percent).filter("row <> first.row").select("row"),
            "gone")
        # The dropped rows are the narrow side; a small one is broadcast, once its size is known.
        return scratch.finish(
            table.join(gone, "row", "left_anti").select(*at.values()).toDF(*names))
    except BaseException:
        scratch.drop()
        raise
