"""Mixing, packing, scoring, extraction and records next to plain counterparts."""

import pickle
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import warc
from driftloom.llm.mixing import emitted, mixed
from driftloom.llm.packing import GeneticConfig, pack
from driftloom.llm.toxicity import WORD, Index, ToxicityConfig, Words, fit, scored
from driftloom.llm.toxicity import words as found_words
from driftloom.llm.wrappers import Folded, align, extract, key, main_text, page_wrapper, parse
from test_pairs import words

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_mixing(docs, corpus, none):
    sizes = defaultdict(int)
    for _, t, _, s, _ in corpus:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    rows = mixed(docs).collect()
    taken = defaultdict(int)
    for r in rows:
        goal = 3 * sizes[r["source"]] if r["source"] in capped else weight[r["source"]] * level
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - goal) < 1e-6 * goal and 0 <= r["copies"] <= 3
        assert abs(r["copies"] - r["rate"]) < 1
        taken[r["source"]] += r["copies"] * r["size"]
    assert abs(sum(taken.values()) - total) < 0.35 * total
    again = mixed(docs.repartition(3)).groupBy().agg(F.sum("copies")).first()[0]
    assert again == sum(r["copies"] for r in rows)
    out = emitted(docs)
    assert out.columns == docs.columns and out.count() == again
    assert emitted(none).count() == 0


def test_mixing_meets_small_sources(spark):
    from driftloom.llm.queries import op2

    rows = op2(spark, "/root/testdata/sf0.01").withColumn("rows", F.lit(1))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    by = rows.join(docs, "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("rows").alias("rows")
    ).collect()
    assert len(by) > 10 and all(abs(r["taken"] - r["target"]) <= 0.15 * r["target"] for r in by)
    assert rows.where("taken > 3 * size").isEmpty()


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 9, 7)], "doc_id long, text string, source string, of_source string, draw int, size int")
    out = mixed(docs).first()
    assert out["size"] == 3 and out["copies"] == 1
    assert emitted(docs).collect() == docs.collect()


def _least_bins(lengths, size):
    """Lower bound that also counts pieces too long to share a bin with others of at least k."""
    best = 0
    for k in range(size // 2 + 1):
        alone = [x for x in lengths if x > size - k]
        big = [x for x in lengths if size - k >= x > size // 2]
        mid = [x for x in lengths if size // 2 >= x >= k]
        room = size * len(big) - sum(big)
        best = max(best, len(alone) + len(big) + max(0, -(-(sum(mid) - room) // size)))
    return best


def test_packing(docs, corpus, none):
    t = Tokenizer.from_file(TOKENS)
    want = defaultdict(int)
    for d, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 512)):
            own = ids[s : s + 512]
            want[str(d), p, s, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))] += 1
    rows = pack(docs, TOKENS, 512, GeneticConfig(chunk_pieces=100)).collect()
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= _least_bins([r["length"] for r in rows], 512) * 1.02 + 2
    assert pack(none, TOKENS).count() == 0


def test_packing_repeats(docs):
    one, two = (sorted(map(tuple, pack(docs, TOKENS).select("doc_id", "piece", "sequence_id").collect()), key=str) for _ in range(2))
    assert one == two


def test_toxicity_nearest_is_exact(spark, none):
    bad, rows, labels = ["vile", "foul", "nasty"], [], []
    rng = np.random.default_rng(1)
    for i in range(600):
        toxic = i % 5 == 0
        own = ["c%d" % rng.integers(90) for _ in range(20)]
        rows.append((i, " ".join(own + ([bad[i % 3], bad[(i + 1) % 3]] if toxic else []))))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "vile foul")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    cfg = ToxicityConfig(least_chi=10.0, block=16)
    model = fit(docs, known, cfg)
    assert set(bad) <= set(model.terms)
    ix = model.index
    for text in ("vile c1 c2", "foul nasty", "c5 c6 vile vile"):
        terms, weights = model.vector(text)
        cos = [0.0] * len(ix.labels)
        for t, w in zip(terms, weights):
            for r in range(ix.ranges):
                for p in range(ix.cut[t * ix.ranges + r], ix.cut[t * ix.ranges + r + 1]):
                    cos[ix.example[p]] += w * ix.weight[p]
        best = sorted(((-c, i) for i, c in enumerate(cos) if c > 0))[: model.k]
        got = ix.nearest(terms, weights, model.k)
        assert [i for _, i in best] == [i for _, i in got]
        assert all(abs(-a - b) < 1e-9 for (a, _), (b, _) in zip(best, got))
    out = {r["doc_id"]: r for r in scored(docs, model, cfg).collect()}
    held = [i for i in range(600) if i % 2]
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert 0 <= out[900]["score"] == out[901]["score"] < 0.5 and out[None]["predicted"] == 1
    assert fit(none, known.limit(0)) is None and scored(docs, None).where("score != 0").isEmpty()


def test_toxicity_small_input_and_all_words(spark):
    rng = np.random.default_rng(4)
    bad = ["scum", "moron", "trash", "loser"]
    rows = []
    for i in range(90):
        own = ["c%d" % x for x in rng.integers(0, 60, 15)] + ["only%d" % i]
        rows.append((i, " ".join(own + ([bad[i // 6 % 4], bad[(i // 6 + 1) % 4]] if i % 6 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(66)], "doc_id long, toxic int")
    model = fit(docs, known)
    assert {w for _, t in rows[:66] for w in t.split()} == set(model.terms)
    out = {r["doc_id"]: r["predicted"] for r in scored(docs, model).collect()}
    assert [out[i] for i in range(66, 90)] == [int(i % 6 == 0) for i in range(66, 90)]


def test_toxicity_pruning_is_exact():
    rng = np.random.default_rng(6)
    vectors = []
    for n in rng.integers(0, 90, 3000):
        t = np.unique(np.minimum(rng.zipf(1.3, n), 800) - 1)
        w = rng.random(len(t)) * np.log(2 + t) + 1e-3
        vectors.append((t, w / max(1e-9, np.sqrt((w * w).sum()))))
    vectors[20:40] = [vectors[50]] * 20  # ties
    sizes = np.array([len(t) for t, _ in vectors])
    index = Index(np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), sizes, rng.integers(0, 2, 3000), np.arange(3000), 800, 64)
    dense = np.zeros((3000, 800))
    for e in range(3000):
        own = slice(index.ends_of[e], index.ends_of[e + 1])
        dense[e, index.terms_of[own]] = index.weights_of[own]
    for q in [*range(0, 3000, 60), 50]:
        if not len(vectors[q][0]):
            continue
        for skip in (None, q):
            cos = dense[:, vectors[q][0]] @ vectors[q][1]
            if skip is not None:
                cos[skip] = 0
            got = index.nearest(*vectors[q], 15, skip)
            want = np.sort(cos)[::-1][:15]
            assert np.allclose([c for c, _ in got], want[want > 0], atol=1e-9) and len({e for _, e in got}) == len(got)
            assert all(abs(cos[e] - c) < 1e-9 for c, e in got)


def test_toxicity_sections_spare_work():
    rng = np.random.default_rng(7)
    vectors = []
    for i in range(1200):  # four languages, their words do not meet
        t = np.unique(rng.integers(0, 300, 60)) + 300 * (i % 4)
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    sizes = np.array([len(t) for t, _ in vectors])
    index = Index(np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), sizes, np.zeros(1200, int), np.arange(1200), 1200, 32)
    assert len(index.sections) > 4
    # words of one language are frequent among their like, so few postings are left to add up one by one
    loose = [np.where(index.row_of[t] < 0, np.diff(index.cells[t], axis=1), 0).sum() for t, _ in vectors]
    assert np.mean(loose) < 0.5 * np.mean([(index.starts[t + 1] - index.starts[t]).sum() for t, _ in vectors])
    dense = np.zeros((1200, 1200))
    for e in range(1200):
        own = slice(index.ends_of[e], index.ends_of[e + 1])
        dense[e, index.terms_of[own]] = index.weights_of[own]
    for (t, w), near in zip(vectors, index.nearest_of(vectors, 15, [None] * 1200)):
        cos = dense[:, t] @ w
        assert np.allclose([c for c, _ in near], np.sort(cos)[::-1][:15], atol=1e-9)
        assert all(abs(cos[e] - c) < 1e-9 for c, e in near)


def test_toxicity_words_of_both_paths():
    every = "".join(map(chr, range(128))) + " It's A_b-c\tD1"
    assert found_words(every) == WORD.findall(every.lower()) and found_words(every + " Über")[-1] == "über"
    held = Words(pa.array(["b", "ü", "a"]))
    assert [held.get(w, -1) for w in ("a", "b", "c", "ü")] == [2, 0, -1, 1]
    assert list(pickle.loads(pickle.dumps(held))) == ["b", "ü", "a"] and not list(Words(pa.array([], pa.string())))


def test_toxicity_held_out_accuracy(spark):
    from driftloom.llm.queries import op5

    sf = "/root/testdata/sf0.1"
    rows = op5(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = {(r["toxic"], r["predicted"]): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] / (got[1, 1] + got.get((1, 0), 0)) > 0.8
    assert got.get((0, 1), 0) / (got[0, 0] + got.get((0, 1), 0)) < 0.02


PAGE = (
    '<html><head><title>t</title><script>x="</p>"</script></head><body><header>Site</header><nav><ul>{nav}</ul></nav>'
    '<div class="cookie-notice">We use cookies</div><main><article><h1>{h}</h1>{ps}<form><p>Mail us</p></form></article>'
    '<section class="comments"><p>First!</p></section></main><aside>More</aside><footer>&copy; me</footer></body></html>'
)


def _page(k):
    ps = "".join(f"<p>Text {k}&amp;{j} <b>bo</b>ld<br>next\n line" + ("</p>" if j % 2 else "") for j in range(1 + k % 4))
    return PAGE.format(nav="".join(f"<li><a href='#'>n{j}</a></li>" for j in range(k % 3 + 1)), h=f"Head {k}", ps=ps)


def _main(k):
    return " ".join([f"Head {k}"] + [f"Text {k}&{j} bold next line" for j in range(1 + k % 4)])


def test_extraction(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", _page(k)) for k in range(40)] + [
        (90, None, None), (91, "http://h1.org/", ""), (92, "x", "plain words"), (93, "http://h1.org/z", "<div>no article</div>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (1 << 26, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, limit).collect()}
        assert {k: got[k] for k in range(40)} == {k: _main(k) for k in range(40)}
        assert (got[90], got[91], got[92], got[93]) == ("", "", "plain words", "no article")
    assert extract(df.limit(0)).count() == 0


def test_wrapper_is_union_free():
    a, b = (page_wrapper(*parse(f"<div><h1>{t}</h1>{'<p>x</p>' * n}{extra}</div>")) for t, n, extra in (("A", 3, ""), ("B", 5, "<ul><li>q</li></ul>")))
    both = align(a, b)
    assert [key(x) for x in both] == ["div", "h1", "#", "/h1", "+(p # /p)", "?(ul li # /li /ul)", "/div"]
    assert both[2] == ["#", None] and both[4][1][1] == ["#", "x"]
    folded = Folded.of("<p>x</p>")
    assert main_text("<p>x</p>", folded.rule()) == "x"


def _extracted(pages):
    """Texts of pages of one host."""
    folded = Folded.of(pages[0])
    for p in pages[1:]:
        folded.merge(Folded.of(p))
    rule = folded.rule()
    return [main_text(p, rule) for p in pages]


def _prose(seed, n=60):
    return " ".join("v%d" % x for x in np.random.default_rng(seed).integers(0, 10**6, n))


def test_extraction_keeps_headline_and_intro():
    page = (
        "<body><div class='w-1/2 tagline'>All the news</div><article><h1>{}</h1><div class='intro'><p>{}</p></div><div class='body'><p>{}</p><p>{}</p></div>"
        "</article><div class='more'><p><a href='/'>Other {}</a></p></div></body>"
    )
    parts = [(_prose(k, 5), _prose(k + 100, 20), _prose(k + 200, 90), _prose(k + 300, 90)) for k in range(6)]
    assert _extracted([page.format(*p, k) for k, p in enumerate(parts)]) == [" ".join(p) for p in parts]


def test_template_texts_are_whole_and_in_place():
    same = "Standard opening " * 20
    page = "<body><div class='top'><p>All the news</p></div><article><h1>{}</h1><div class='lead'><p>{}</p></div><p>{}</p></article></body>"
    parts = [(_prose(k, 5), same + _prose(k + 100), _prose(k + 200, 90)) for k in range(6)]
    assert _extracted([page.format(*p) for p in parts]) == [" ".join(p) for p in parts]
    parts[4] = (_prose(4, 5), "All the news", _prose(204, 90))  # the template's text, elsewhere
    assert _extracted([page.format(*p) for p in parts]) == [" ".join(p) for p in parts]


def test_revisions_of_a_page_are_no_template():
    page = "<body><article><h1>{}</h1><h2>Part one</h2><p>{}</p><h2>Part two</h2><div><p>{}</p></div></article></body>"
    base = _prose(1, 90).split()

    def revision(k):
        return "A headline", " ".join([*base[:k], "edited", *base[k + 1 :]]), _prose(2, 30)

    def whole(p):
        return f"{p[0]} Part one {p[1]} Part two {p[2]}"

    a, b, c = (revision(k) for k in (10, 30, 50))
    for order in ((a, b, a), (a, a, b), (b, a, a), (a, b, c), (c, a, b, a, c)):
        assert _extracted([page.format(*p) for p in order]) == [whole(p) for p in order]
    rows = [("A headline", _prose(k, 60), _prose(k + 50, 30)) for k in (11, 12, 13)]
    assert _extracted([page.format(*p) for p in rows]) == [f"{p[1]} {p[2]}" for p in rows]


def test_marks_are_whole_tokens():
    page = "<body><div class='content has-sidebar'><p>{0}</p></div><div class='sidebar'>s {0}</div><div class='cookie-notice'>c {0}</div></body>"
    texts = [_prose(k) for k in range(4)]
    assert _extracted([page.format(t) for t in texts]) == texts


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x &amp; y</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (None, "http://b/", "é" * 3), (1, "http://a/", "<p>x &amp; y</p>\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    source = warc.responses(pages)
    made = warc.derive(source)
    assert made.count() == 8
    joined = made.alias("m").join(source.select("record_id", "payload_digest").distinct().alias("s"), F.expr("m.refers_to = s.record_id and m.payload_digest = s.payload_digest"))
    assert joined.count() == 8
    text = {r["refers_to"]: r["block"] for r in made.where("warc_type = 'conversion'").collect()}
    assert sorted(text.values()) == ["", "x & y WARC/1.1", "ééé"]
    whole = source.select("headers", "block").unionAll(made.select("headers", "block"))
    warc.write(whole, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    names = ["warc_type", "record_id", "refers_to", "target_uri", "block_digest", "content_length"]
    want = source.select(names).unionAll(made.select(names)).collect()
    assert sorted(map(str, back.select(names).collect())) == sorted(map(str, want))
    assert back.where("block_digest != concat('sha256:', sha2(block, 256))").isEmpty()


def test_warc_plain_text(spark):
    want = {
        "<p>it&#8217;s a&#x2014;b&mdash;caf&eacute;&hellip;</p>": "it’s a—b—café…",
        "&amp;lt; &amp;#38; &lt;b&gt; &#38;amp; &nosuch; &; &#; R&D &NotEqualTilde;": "&lt; &#38; <b> &amp; &nosuch; &; &#; R&D ≂̸",
        "x&nbsp;&#160;&#xA0;y &amp 1 &notit; &#150; &#0;": "x y &amp 1 &notit; – \ufffd",
        "a<script>if (a < b) { c('</p>') }": "a",
        "a <STYLE type='x'>p{}</style >b<!-- <script> -->c<script>'<!--'</script>d<!-->e<!-- open <p>f</p>": "a b c d e",
        "no reference": "no reference",
    }
    rows = spark.createDataFrame([(p,) for p in [*want, None]], "page string").repartition(3)
    got = {r[0]: r[1] for r in rows.select("page", warc.plain_text(F.col("page"))).collect()}
    assert got == {**want, None: None}


def test_marks_and_hidden_elements_do_not_swallow_articles(spark):
    from driftloom.llm.wrappers import extract

    text = "A first sentence of the article stands here. " * 4
    pages = [
        ("a", f"<article class='overflow-hidden'><p>{text}</p></article>", text),
        ("b", f"<div title='a hidden gem' data-state='hidden-on-scroll'><p>{text}</p></div>", text),
        ("c", f"<div class='post share'><h1>Head</h1><p>{text}</p><div class='sidebar'>Side</div></div>", "Head " + text),
        ("d", f"<div><p>{text}</p><p>Let <math><mi>x</mi></math> be.</p><noscript>Plain.</noscript></div>", text + " Let x be. Plain."),
        ("e", f"<p>{text}</p><div hidden><p>{text} no</p></div><div aria-hidden='true'>no</div><div hidden='hidden'>no</div>", text),
        ("f", f"<h1>Head</h1><p>{text}</p><div class='comments'><p>{text * 5} no</p></div>", "Head " + text),
    ]
    rows = [(i, f"http://{h}.example/{i}", html) for i, (h, html, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {i: " ".join(want.split()) for i, (*_, want) in enumerate(pages)}


def test_warc_ids_tell_payloads_apart(spark):
    rows = [(None, None, "<p>a"), (None, None, "<p>b"), (1, "u", "<p>a"), (1, "u", "<p>b")]
    source = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = warc.derive(source)
    assert source.select("record_id").distinct().count() == 4
    assert made.select("record_id").distinct().count() == made.count() == 8
    assert made.join(source.select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("d")), "refers_to").where(
        "d = payload_digest").count() == 8


def test_idle_worker_gives_back_what_it_made(spark, monkeypatch):
    """After its last task a model keeps only what was sent; a later task finds the same again."""
    import time

    from driftloom.llm import toxicity

    monkeypatch.setattr(toxicity, "REST_S", 0.2)
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} some text {'bad' * (i % 3 == 0)}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    texts = ["word1 some bad", "word2 text", ""]
    fresh = pickle.loads(pickle.dumps(model))
    with fresh.awake() as m:
        before = m.near(texts)
        time.sleep(0.5)
        assert "rows" in vars(m.index) and "get" in vars(m.terms)  # never during a task
    time.sleep(0.6)
    assert not set(vars(fresh.index)) & set(toxicity.Index.MADE) and "get" not in vars(fresh.terms)
    with fresh.awake() as m:
        assert m.near(texts) == before
    assert before == model.near(texts)


def test_parts_of_ranges_change_no_neighbour(monkeypatch):
    from driftloom.llm import toxicity

    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(1500):
        t = np.unique(rng.integers(0, 400, 12))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    sizes = np.array([len(t) for t, _ in vectors])
    made = []
    for part in (64, 1 << 20):
        monkeypatch.setattr(toxicity, "PART", part)
        made.append(toxicity.Index(np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), sizes, np.zeros(1500, int), np.arange(1500), 400, 1024))
    fine, whole = made
    assert fine.block == 64 and whole.block == 1024 and (fine.names == whole.names).all()
    got = [ix.nearest_of(vectors[:80], 5, [None] * 80) for ix in made]
    assert [[e for _, e in x] for x in got[0]] == [[e for _, e in x] for x in got[1]]
