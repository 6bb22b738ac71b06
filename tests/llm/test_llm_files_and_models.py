"""Token store, WARC bundles, URL model, HTML extraction and toxicity."""

import base64
import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from replyloom.llm import html_extract, toxicity, url_model
from replyloom.llm.common import Scratch
from replyloom.llm.boosting import fit_trees
from replyloom.llm.elias_fano import EliasFano, encode
from replyloom.llm.files import open_folder
from replyloom.llm.html_extract import Page, decode, extract, extract_main_text, train_extractor
from replyloom.llm.queries import QUERIES
from replyloom.llm.token_store import ChunkEncoder, ShardReader, read_store, write_store
from replyloom.llm.toxicity import (Composition, Grammar, held_out, learn_grammar, score_documents)
from replyloom.llm.url_model import judge_urls
from replyloom.llm.warc_store import (BundleReader, fetch_record, payload_digest, read_archives,
                                      write_archives)
from replyloom.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 10**12))
def test_elias_fano_round_trip(steps, first):
    values = (np.cumsum(steps) + first).tolist() if steps else []
    coded = EliasFano(encode(values))
    assert len(coded) == len(values)
    assert [coded.select(i) for i in range(len(values))] == values
    assert coded.values().tolist() == values


def test_elias_fano_space_and_order():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    bits = 8 * len(encode(values)) / len(values)
    assert bits < 2 + math.log2(values[-1] / len(values)) + 1
    with pytest.raises(ValueError):
        encode([2, 1])


ODD_TEXTS = [None, "", " \n", "Hello  WORLD's it's 2024!!", "e\u0301 \u0301x é\u00a0É\u2003z",
             "a\x0bb\x0cc\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "ﬁ İ ẞ Σας", "日本 語😀",
             "\r\n\t'S 'll 'x", "word " * 3000, "Ünïcödé, ÀÉ!! ñandú... don't_x a_b ΣΑΣ. ŒUVRE; Ǆ, ªº, x=y, ab=, "
             "ŉ. ß, ℵ. ＡＢ, ǰ, Å\u030a. K, Å, 각, ก็. (word) word) it’s, naïve”, x\u0338= ='s."]


def test_chunks_encode_as_the_whole_text():
    library = Tokenizer.from_file(TOKENIZER)
    encoder = ChunkEncoder(TOKENIZER, 2)
    rng = random.Random(4)
    letters = "ab É\u0301'sS9!<|>\n\t\u00a0\u200d\x1f日,=İßΣς_Å\u0338"
    texts = [t or "" for t in ODD_TEXTS] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts], 1)):
        expected = library.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(got, "<u2").tolist() == expected, repr(text)


def tasks_of(df):
    """Tasks that give rows, with adaptive merging of small partitions on."""
    assert df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    return df.select(F.spark_partition_id().alias("part")).distinct().count()


def test_token_store_round_trip(spark):
    library = Tokenizer.from_file(TOKENIZER)
    rows = [(i * 3 - 5, t, i) for i, t in enumerate(ODD_TEXTS * 3)] + [(None, "null id", 1)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    folder = scratch_path(spark, "tokens")
    manifest = write_store(docs, folder, TOKENIZER, shard_ids=700)
    got = sorted(read_store(manifest, folder).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    start = 0
    for r, (doc_id, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)),
                                    strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.count() > 1
    assert tasks_of(read_store(manifest, folder)) == manifest.count()
    shard = manifest.first()
    reader = ShardReader(folder, shard["file"])
    assert reader.bounds.select(len(reader) - 1) == shard["n_ids"]
    reader.close()
    empty = write_store(docs.limit(0), scratch_path(spark, "tokens"), TOKENIZER)
    assert read_store(empty, folder).count() == 0


def page_rows():
    bodies = [None, "", "<p>a</p>", "<p>a</p>", "x" * 5000, "é" * 10, "<p>a</p>"]
    rows = [(i, f"http://h/{i}", b, "d") for i, b in enumerate(bodies)]
    return rows + [(6, "http://h/6", "<p>a</p>", "d"), (None, None, "x" * 5000, "d"),
                   (9, "http://h/ü q", "only\r\n\r\nWARC/1.1", "d")]


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_archives_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc")
    index = write_archives(pages, folder, min_bytes=min_bytes, frame_bytes=600, bundle_bytes=2000)
    got = read_archives(index, folder, with_payload=True).collect()
    many = write_archives(pages, folder, min_bytes=min_bytes, frame_bytes=100, bundle_bytes=1)
    assert tasks_of(read_archives(many, folder)) == many.select("bundle").distinct().count() > 2
    groups = defaultdict(list)
    for page_id, _, body, _ in page_rows():
        groups[(body or "").encode()].append(page_id)
    expected = Counter()
    for payload, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i))
        for n, page_id in enumerate(sorted(ids, key=lambda i: (i is not None, i), reverse=True)):
            single = n == 0 or len(payload) < min_bytes
            expected[(page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                      "response" if single else "revisit", None if single else best)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got) == expected
    for r in got:
        assert r.record_type == "revisit" or payload_digest(r.payload) == r.payload_digest
    for row in index.collect():
        headers, content = fetch_record(row.asDict(), folder)
        assert headers["WARC-Record-ID"] == f"<{row.record_id}>"
        assert int(headers["Content-Length"]) == len(content)
    # Any reader gets through a bundle from end to end.
    name = index.first()["bundle"]
    system, path = open_folder(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
        data = stream.read()
    plain = zstandard.ZstdDecompressor().stream_reader(
        io.BytesIO(data), read_across_frames=True).read()
    reader = BundleReader(folder, name)
    assert plain == b"".join(reader.frame(k) for k in range(len(reader.frames)))
    reader.close()
    assert read_archives(write_archives(pages.limit(0), scratch_path(spark, "warc")), folder).count() == 0


def brute_url(url):
    text = url or ""
    if "://" not in text:
        return "", "", None
    rest = text.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, _ in url_model.RULES:
        name, _, more = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + more):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def brute_difference(text, training, order):
    """Log-likelihood difference per character under the two models."""
    total = 0.0
    padded = url_model._START * order + text + url_model._END
    for sign, own in ((1, True), (-1, False)):
        seen, after = Counter(), defaultdict(set)
        for other in (t for t, accepted in training if accepted == own):
            p = url_model._START * order + other + url_model._END
            for i in range(order, len(p)):
                for k in range(order + 1):
                    seen[(p[i - k:i], p[i])] += 1
                    after[p[i - k:i]].add(p[i])
        sums = Counter()
        for (context, _), n in seen.items():
            sums[context] += n
        for i in range(order, len(padded)):
            p = 1.0 / url_model.ALPHABET
            for k in range(order + 1):
                context = padded[i - k:i]
                if sums[context]:
                    kinds = len(after[context])
                    p = (seen[(context, padded[i])] + kinds * p) / (sums[context] + kinds)
            total += sign * math.log(p)
    return total / (len(padded) - order)


def test_urls_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.net", "x.example.net", "example.com", "B.Org", "shop.com", "net", "b.c.org", "x.edu"]
    urls = [None, "", "no scheme", "http://", "HTTP://NET", "http://a.net?x=/", "http://É.Org/fr/x",
            "a://b://c/d", "http://notnet/", "http://example.org\n/fr/"]
    urls += [f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'fr/', ''])}{rng.randrange(30)}"
             for _ in range(150)]
    rows = [(i, u, "r", "t") for i, u in enumerate(urls)] + [(3, urls[12], "r", "t"), (None, urls[13], "r", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, text string")
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    by_url = {(r.host, r.path): r for r in got}
    verdicts = dict(url_model.RULES)
    parsed = {brute_url(u) for u in urls}
    folds = {r[0]: r[1] for r in spark.createDataFrame([(h,) for h in {p[0] for p in parsed}], "h string")
             .selectExpr("h", f"pmod(xxhash64(h), {url_model.HELD_OUT}) = 0").collect()}
    training = [(h + p, verdicts[r] == "allow") for h, p, r in parsed if r and not folds[h]]
    for u in urls:
        host, path, rule = brute_url(u)
        r = by_url[(host, path)]
        assert r.rule == rule
        if rule:
            assert r.verdict == verdicts[rule]
        else:
            assert abs(r.score - brute_difference(host + path, training, url_model.ORDER)) < 1e-6
            assert r.verdict == ("allow" if r.score >= r.threshold else "block")
    assert judge_urls(pages.limit(0)).count() == 0
    free = judge_urls(pages.filter("url like '%shop%'")).collect()
    assert {(r.score, r.verdict) for r in free} == {(0.0, "allow")}


ARTICLE = ("<html><body><div class='site-nav'><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8))
           + "</ul></div><div id='content'><h1>A title</h1>"
           + "".join(f"<p>Sentence number {i} of the text, with <b>bold</b> words and\n\tmore &amp; more.</p>" for i in range(6))
           + "</div><div class='comments'><p>Nice post, I think.</p></div><div class=\"footer\">&copy; 2024</div>"
           "<script>var x = '</p>';</script></body></html>")


def test_page_parsing():
    page = Page("<p>a<p>b<br>c<ul><li>d<li>e</ul>t<!-- x --> u<style>p{}</style>&lt;i&gt;<table><tr><td>1<td>2</table>< 3")
    assert [t for _, t in page.blocks()] == ["a", "b c", "d", "e", "t u<i>", "1", "2", "< 3"]
    assert [t for _, t in Page("").blocks()] == [] == [t for _, t in Page("<script>x").blocks()]
    assert [t for _, t in Page("a\u00a0 b <div class=\"x").blocks()][0] == "a b"


def test_decoding_never_contradicts():
    rng = np.random.default_rng(3)
    page = Page("<div><section><p>a</p><p>b</p></section><section><p>c</p></section></div>" * 3)
    for _ in range(50):
        gain = rng.normal(size=len(page.tag))
        stays = decode(page, gain)
        assert all(stays[page.parent[i]] for i in range(1, len(stays)) if stays[i])
        total = sum(g if s else -g for g, s in zip(gain[1:], stays[1:]))
        assert total >= abs(np.sum(gain[1:])) - 1e-9  # keeping or dropping all is never better


def test_decoding_finds_the_best_choice():
    rng = np.random.default_rng(6)
    page = Page("<div><p>a</p><section><p>b</p><p>c</p></section></div><div><p>d</p></div>")
    n = len(page.tag)
    allowed = [s for s in itertools.product((False, True), repeat=n - 1)
               if all(page.parent[i] == 0 or s[page.parent[i] - 1] for i in range(1, n) if s[i - 1])]
    for _ in range(30):
        gain = rng.normal(size=n)
        stays = decode(page, gain)
        best = max(sum(g if s else -g for g, s in zip(gain[1:], choice)) for choice in allowed)
        assert sum(g if s else -g for g, s in zip(gain[1:], stays[1:])) == pytest.approx(best)


@pytest.mark.parametrize("n", [3, 64, 65, 500])
def test_sibling_share_is_counted_however_many_there_are(n):
    page = Page("<section>" + "<p>a</p>" * n + "<aside>b</aside></section>")
    at = html_extract.FEATURES.index("same_siblings")
    rows = html_extract.node_features(page, page.blocks())
    for tag, share in (("p", n / (n + 1)), ("aside", 1 / (n + 1))):
        own = [rows[i][at] for i in range(len(page.tag)) if page.tag[i] == tag]
        assert own == pytest.approx([share] * len(own))


def test_training_pages_are_chosen_among_those_small_enough(spark):
    long = "<html><body><article>" + "<p>x</p>" * 3000 + "</article></body></html>"
    pages = spark.createDataFrame([(i, long) for i in range(30)] + [(99, ARTICLE)], "page_id long, html string")
    trees = train_extractor(pages, max_pages=1, max_bytes=5000)
    assert "Link 1" not in extract([ARTICLE], trees)[0] and "Sentence number 5" in extract([ARTICLE], trees)[0]


def test_extraction_learns_from_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trees = train_extractor(pages)
    out = {r.page_id: r for r in extract_main_text(pages, trees).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    import html as library
    import re
    for r in rows:
        source = r.html[r.html.index("<article>"):].split("</article>")[0]
        parts = re.split(r"<(?:p|h1)>", source)
        texts = (" ".join(library.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
        assert out[r.page_id].text == "\n\n".join(t for t in texts if t)
        assert out[r.page_id].n_chars == len(out[r.page_id].text)
    assert extract([ARTICLE], trees)[0].startswith("A title\n\nSentence number 0 of the text, with bold words and more & more.")
    assert "Nice post" not in extract([ARTICLE], trees)[0] and "Link 1" not in extract([ARTICLE], trees)[0]
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (1, None, None, "t")],
                                "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract_main_text(odd, trees).collect()) == [("", 0)] * 3
    assert train_extractor(odd.limit(0)).margin(np.zeros((2, 3))).tolist() == [1.0, 1.0]


def test_boosting_fits_an_exclusive_or():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit_trees(x, y).margin(x) > 0) == y).mean() > 0.97


def test_grammar_events():
    machine = Composition()

    def events(symbols):
        state, out = machine.start, []
        for s in symbols:
            state, event = machine.step(state, s)
            out.append(event)
        return [e for e in out if e]

    assert events("oIo") == ["I"] and events("NoI") == ["In"] and events("NooooI") == ["I"]
    assert events("RoooooI") == ["Ir"] and events("GI") == ["Ig"] and events("T") == []
    assert events("ToG") == ["T"] and events("NTG") == ["Tn"]


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grammar = learn_grammar(docs, labels)
    got = {r.doc_id: r for r in score_documents(docs, grammar).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(got[i], t) for i, t in truth.items() if got[i].held_out]
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())
    hits = sum(g.predicted == 1 and t == 1 for g, t in rows)
    # Some toxic words of this table are built like its clean ones; measured 0.93 and 0.97.
    assert hits / sum(t == 1 for _, t in rows) > 0.9
    assert hits / max(1, sum(g.predicted for g, _ in rows)) > 0.9
    assert all(0 <= g.score <= 1 for g in got.values())


def test_toxicity_edge_cases(spark):
    odd = spark.createDataFrame([(1, None, 2.0), (None, "", 2.0), (1, None, 2.0), (2, "you idiot", 2.0)],
                                "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    grammar = learn_grammar(odd, labels)
    rows = score_documents(odd, grammar).collect()
    # Nothing toxic to learn from: the prior insults count, and texts without words score low.
    assert len(rows) == 4
    assert sorted((str(r.doc_id), r.predicted) for r in rows) == [
        ("1", 0), ("1", 0), ("2", 1), ("None", 0)]
    assert score_documents(odd.limit(0), Grammar()).count() == 0
    assert not odd.select(held_out(odd["doc_id"]).alias("h")).filter("h is null").count()


def plain_score(text, grammar):
    """The score with every event found by looking around in its clause, without transducers."""
    values = []
    for line in text.split("\n"):
        clause, words = [], line.split()
        for at, word in enumerate(words, 1):
            clause.append(word)
            if word.endswith((".", "!", "?", ";", ":", "…")) or at == len(words):
                symbols = [grammar.symbol(toxicity._plain(w)) for w in clause]
                kinds = [k for k, _ in symbols]
                total = 0.0
                for i, (kind, weight) in enumerate(symbols):
                    near = kinds[max(0, i - 5):i]
                    threat = kind == "G" and "T" in near and "G" not in near[::-1][:near[::-1].index("T")]
                    if kind == "I" or threat:
                        value = grammar.threat if threat else weight
                        value *= 1.5 if kind == "I" and "G" in near else 1.0
                        value *= 0.1 if "N" in kinds[max(0, i - 3):i] else 1.0
                        value *= 0.1 if "R" in kinds[:i] else 1.0
                        total += value
                values.append(total)
                clause = []
    total, n_words = sum(values), len(text.split())
    x = [np.log1p(total), np.log1p(sum(min(1, v / 2) for v in values)),
         np.log1p(100 * total / max(100, n_words))]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, grammar.weights) + grammar.bias, -30, 30)))


def test_toxicity_scores_against_a_plain_scorer(spark):
    rng = random.Random(5)
    words = ["you", "idiot", "moron", "not", "never", "said", "kill", "burn", "them", "weather",
             "tree", "house.", "rain;", "snow", "no", "stone", "sea", "wind", "sky", "lake"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 9, 30, 200))))
             for _ in range(300)] + ["", "idiot\nidiot"]
    grammar = Grammar(words={"idiot": 4.0, "moron": 1.5}, threat=3.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(docs, grammar).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(text, grammar), abs=1e-12), text


def test_clauses_decide_the_order_of_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grammar = learn_grammar(docs, labels)
    texts = ["idiot", "you idiot", "I will kill you", "you are not an idiot",
             "he said you are an idiot", "a fine day", "I will not kill you", "kill the lights"]
    rows = score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                           grammar).orderBy("doc_id").collect()
    bare, aimed, threat, negated, reported, clean, denied, harmless = (r.score for r in rows)
    assert aimed > bare > 0.3 and threat > 0.3
    assert max(negated, reported, denied) < 0.3 and max(negated, reported, denied) < bare
    assert clean == harmless < 0.1
    assert all(w >= 0 for w in grammar.weights)


def toxicity_sample(spark, texts):
    """Documents with labels, under ids that are learned from."""
    usable = (i for i in range(100_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, text, toxic) for i, (text, toxic) in zip(usable, texts)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return both.select("doc_id", "text"), both.select("doc_id", "toxic")


def test_toxicity_learns_rare_insults_beside_a_much_copied_text(spark):
    # The copied text has over 4,000 tokens, each in more toxic rows than the insult.
    long = " ".join(f"w{i:05d}x" for i in range(5000))
    texts = [(long, 1)] * 60 + [(f"zonko day{i}", 1) for i in range(8)]
    texts += [(f"fine day{i} plain", 0) for i in range(60)]
    grammar = learn_grammar(*toxicity_sample(spark, texts))
    assert grammar.words.get("zonko") or any("zonko".startswith(p) for p in grammar.prefixes)
    assert not any(w.startswith("w0") for w in [*grammar.words, *grammar.prefixes])


def test_toxicity_chooses_alike_however_many_arcs_come_at_a_time(spark):
    rng = random.Random(5)
    words = [f"{rng.choice(['gra', 'gru', 'blo'])}{rng.choice('abcd')}{i % 9}{i}" for i in range(60)]
    texts = [(" ".join(rng.sample(words, 6)), 1) for _ in range(80)]
    texts += [(" ".join(rng.sample(words, 1) + [f"c{i}"]), 0) for i in range(80)]
    docs, labels = toxicity_sample(spark, texts)
    training = toxicity._training(docs, labels, "doc_id", "text", "toxic", 1000).toArrow().to_pylist()
    training = spark.createDataFrame([(r["label"], r["text"], i) for i, r in enumerate(training)],
                                     "label int, text string, row long")
    candidates = Scratch(spark, "test").write(toxicity._candidates(training), "candidates")
    toxic_rows = [r.row for r in training.filter("label = 1").collect()]
    # All candidates in one list, chosen from as the docstring says.
    left = {r.token: (r.precise, set(r.rows)) for r in candidates.collect()}
    need, want = dict.fromkeys(toxic_rows, toxicity.COVER), []
    while True:
        gains = {t: sum(need[i] > 0 for i in rows) for t, (_, rows) in left.items()}
        gains = {t: g for t, g in gains.items() if g >= toxicity.MIN_TOXIC}
        if not gains:
            break
        best = max(gains, key=lambda t: (gains[t] * left[t][0], len(t), t))
        rows = left.pop(best)[1]
        if any(rows <= w for c, w in want if c[1:].startswith(best[1:]) or best[1:].startswith(c[1:])):
            continue
        want.append((best, rows))
        for i in rows:
            need[i] -= 1
    assert len(want) > 5
    for n in (2000, 3):
        assert list(toxicity._choose(candidates, toxic_rows, n)) == [t for t, _ in want]


@pytest.mark.parametrize("space", ["\u00a0", "\u202f", "\u2003", "\x1c", "\x85", " "])
def test_toxicity_shortcut_agrees_with_the_grammar_at_every_white_space(space):
    grammar = Grammar()
    always = defaultdict(lambda: 1.0)
    for text in (f"idiot{space}!", f"you{space}idiot", f"I will{space}kill{space}you", f"a{space}b",
                 f"not{space}an{space}idiot. he said{space}moron"):
        raw = text.encode()
        shortcut = toxicity.features(raw, grammar, toxicity._Arcs(grammar), Composition())
        assert shortcut == toxicity.features(raw, grammar, always, Composition())
        assert any(shortcut) == (text[0] != "a")
        assert toxicity._tokens_of(raw) == toxicity._tokens_of(text.replace(space, " ").encode())


def test_url_query_scores_scheme_query_and_fragment(spark, tmp_path):
    urls = [f"http://h{i}.net/a{i}?spam=1" for i in range(30)]
    urls += [f"https://h{i}.org/fr/a{i}?page=2#top" for i in range(30)]
    free = ["http://x.edu/a?spam=1", "http://x.edu/a?page=2#top", "https://x.edu/a", None]
    rows = list(enumerate(urls + free))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op5_url_filters"](spark, str(tmp_path)).collect()}
    texts = [u or "" for _, u in rows]
    folds = [r[0] for r in spark.createDataFrame([(i, got[i].host) for i in range(len(rows))], "i int, h string")
             .orderBy("i").selectExpr(f"pmod(xxhash64(h), {url_model.HELD_OUT}) = 0").collect()]
    training = [(texts[i], i >= 30) for i in range(60) if not folds[i]]
    for i in range(60, 64):
        assert abs(got[i].score - brute_difference(texts[i], training, url_model.ORDER)) < 1e-6
    assert got[60].score < got[61].score and (got[60].host, got[60].path) == ("x.edu", "/a")
