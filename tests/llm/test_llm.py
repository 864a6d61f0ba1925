"""Corpus operators against brute force, and their defined results at the edges."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seqfold.llm import bpe, compact_windows, gif, html_extract, line_dedup, mixing, quality_rules, registry, simhash, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE = prose(70)
EDGES = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "x" * 3000), (5, prose(80)), (6, f"{prose(30)} {PASSAGE} {prose(40)}"), (7, f"{PASSAGE}\n{prose(60)}"),
    (8, "é漢字 " * 60), (10, prose(60) + "\n" + "the same line of six words\n" * 3), (11, "the same line of six words"), (12, "the same line of 6 words"),
    (13, "the same long line of six words"), (14, prose(4000)), (15, "Read more here\nRead  more\there\nfour words of it"), (16, "three words of\nRead more here"),
]
EDGES.append((9, dict(EDGES)[5]))
CLASHES = "id words node part host draw at fp n_lines n_removed epochs epoch_no doc gone_id taken_id hit_id failed rejected_host own_salt copy text_ col dropped_id label".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"src{i % 3}", None) for i, t in EDGES]
    rows += [rows[5], (None, prose(60), "en", "src1", None)]  # a repeated row, and one without an id
    extra = spark.createDataFrame(rows, DOCS)
    return extra.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_everything_takes_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.Model(-3.0, {})
    for df in (
        toxicity.score(empty, model), line_dedup.dedup(empty), quality_rules.keep_good(empty), suffix_dedup.digest(empty), mixing.select(empty), gif.digest(empty),
        simhash.group(empty), bpe.digest(empty, public_tokenizers.path(bpe.RANK_FILE)), compact_windows.classes(empty), line_dedup.clean(empty), mixing.mix(empty), simhash.keep_one(empty),
        html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), html_extract.Weights({}, {})),
    ):
        assert df.count() == 0
    assert labels.count() == 0


def test_toxicity_finds_the_sentence(spark, docs):
    bad = ["zorgish", "zorgful", "zorger", "vilekin"]
    texts, labels = [], []
    for k in range(200):
        s = [prose(8) + "." for _ in range(6)]
        if k % 3 == 0:
            s[k % 6] = f"{prose(4)} {bad[k % 4]} {bad[(k + 1) % 4]} {prose(2)}."
        texts.append(" ".join(s))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, labels)
    scorer = toxicity.Scorer(model)
    spans = scorer.spans(texts[3])
    assert "vilekin" in texts[3][slice(*max(spans, key=lambda s: s[2])[:2])]
    held = [f"{prose(8)}. {prose(3)} zorgling zorgish vilekin {prose(3)}.", f"{prose(8)}. {prose(9)}."]
    assert [toxicity.noisy_or([p for *_, p in scorer.spans(t)]) >= 0.5 for t in held] == [True, False]
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    # What is scored is what was fitted: a feature once a sentence, however many words have it.
    twice = toxicity.Scorer(toxicity.Model(-3.0, {"zorg~": 2.0})).spans("zorgish zorgful x.")
    assert abs(twice[0][2] - 1 / (1 + np.exp(1.0))) < 1e-12
    for texts, labels, rate in ((["a. b. c. d."] * 2, [0, 0], 1 / 6), (["a"] * 3, [1] * 3, 3.5 / 4), ([], [], 0.0)):
        one = toxicity.fit(texts, labels)
        assert one.weights == {} and {r.score for r in toxicity.score(docs, one).collect()} == {rate}


def test_toxicity_sample_is_bounded_whatever_the_lengths(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(40)] + [(77, 1), (1, None)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, labels: seen.append((texts, labels))
    try:
        toxicity.train(docs, labels, F.col("doc_id") != 3, 9, 8000)
    finally:
        toxicity.fit = fit
    texts, labels = seen[0]
    assert all(sum(len(t) for t, x in zip(texts, labels) if x == k) <= 4000 for k in (0, 1)) and {len(t) for t in texts} == {10, 1000}


def test_toxicity_held_out_accuracy(spark):
    rows = registry.queries()["op1_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_against_all_pairs(spark, docs):
    lines = [(i, k, re.findall(r"[^\x20\x09-\x0D]+", x)) for i, t in sorted(EDGES) if t is not None for k, x in enumerate(t.split("\n"))]
    full = [x for x in lines if x[2]]
    gone = {(b[0], b[1]) for a, b in itertools.combinations(full, 2) if a[2] == b[2] or min(len(a[2]), len(b[2])) >= 5 and near(a[2], b[2])}
    out = by_id(line_dedup.dedup(docs))
    assert {(12, 0), (13, 0), (15, 1), (16, 1)} <= gone and (16, 0) not in gone
    for i, t in EDGES:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert out[i].text == want and out[i].n_removed == sum(g[0] == i for g in gone)


def test_quality_measures_and_hosts(spark, docs):
    got = collections.defaultdict(list)
    for r in quality_rules.judge(docs).collect():
        got[r.doc_id].append(r)
    for i, t in EDGES:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = collections.Counter(tri)
        covered = {k + j for k, w in enumerate(tri) if n[w] > 1 for j in range(3)}
        full = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(covered))
    rows = [(k, "bad" if k < 40 else f"h{k % 9}", k < 36) for k in range(200)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, f boolean").select("doc_id", "host", *(F.col("f").alias(r) for r in quality_rules.RULES))
    assert {r.host for r in quality_rules.host_verdicts(judged).where("host_rejected").collect()} == {"bad"}
    assert quality_rules.keep_good(docs).columns == docs.columns


def brute_spans(texts, length):
    seen, out = set(), {}
    for i, b in sorted(texts.items()):
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                cover[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(x for x, c in zip(b, cover) if not c), len(re.findall(b"\1+", bytes(cover)))
    return out


def test_suffix_dedup_against_all_strings(spark, docs):
    want = brute_spans({i: (t or "").encode() for i, t in EDGES}, 100)
    got = by_id(suffix_dedup.digest(docs))
    for i, t in EDGES:
        left, spans = want[i]
        n = len((t or "").encode())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, n - len(left), spans, hashlib.sha256(left).hexdigest())
    assert got[None].n_removed == 0


def test_long_blocks_keep_their_places(monkeypatch):
    """Pieces that together would pass what a place can tell go apart."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 11)
    texts = [RNG.integers(97, 123, n).astype(np.uint8).tobytes().decode() for n in (2040, 2130, 5000, 300)]
    texts[3] = texts[1][-250:] + "z" * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sent = suffix_dedup._gather(suffix_dedup._list_segments(1, 100)(iter([batch])))
    found = np.concatenate([suffix_dedup.unpack(x, suffix_dedup.SEGMENT) for x in sent[suffix_dedup.SEGMENTS]])
    for r in found:
        piece = np.frombuffer(texts[r["doc"]][r["start"] : r["start"] + r["n"] + 99].encode(), np.uint8)
        assert r["h"] in suffix_dedup.gram_hashes(piece)


def test_suffix_array_is_exact():
    rng = np.random.default_rng(1)
    for k in range(60):
        t = rng.integers(0, k % 5 + 1, int(rng.integers(0, 150))).astype(np.uint16)
        if k % 3 == 0:
            t = np.tile(t[:9], 7)
        order = suffix_dedup.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_mixing_budgets_fill_siblings_first(spark):
    rows = [(0, "en", "a", 10), (0, "en", "b", 1000), (0, "fr", "c", 1000), (1, "en", "d", 1000)]
    leaves = spark.createDataFrame(rows, "domain int, lang string, source string, tokens long").withColumns({f"{x}_weight": F.lit(1.0) for x in mixing.LEVELS})
    got = {r.source: r.budget for r in mixing.budgets(leaves, 800 / 3010, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}


def fill(budget, children):
    """Budgets of children (name, weight, capacity, ...): by weight, what one can't take to the others."""
    out, left = {}, [c for c in children if c[1] > 0]
    while left:
        level = budget / sum(c[1] for c in left)
        full = [c for c in left if c[2] <= level * c[1]]
        if not full:
            return out | {c[0]: level * c[1] for c in left}
        out |= {c[0]: c[2] for c in full}
        budget, left = budget - sum(c[2] for c in full), [c for c in left if c not in full]
    return out


def test_mixing_budgets_on_random_trees(spark):
    rng = np.random.default_rng(8)
    for trial in range(3):
        rows = [(d, g, f"s{k}", int(rng.integers(1, 1000)), float(d + 1), float(rng.integers(0, 4)) if g == "x" else 2.0, float(rng.integers(1, 5))) for d in range(3) for g in "xyz" for k in range(int(rng.integers(1, 4)))]
        rows = [(*r[:5], next(q[5] for q in rows if q[:2] == r[:2]), r[6]) for r in rows]
        leaves = spark.createDataFrame(rows, "domain int, lang string, source string, tokens long, domain_weight double, lang_weight double, source_weight double")
        share, epochs = (0.3, 0.9, 1.7)[trial], 2
        cap = lambda test: 2.0 * sum(r[3] for r in rows if test(r))
        want = {}
        tops = fill(share * sum(r[3] for r in rows), [(d, d + 1.0, cap(lambda r: r[0] == d)) for d in range(3)])
        for d, top in tops.items():
            mids = fill(top, [(g, next(r[5] for r in rows if r[:2] == (d, g)), cap(lambda r: r[:2] == (d, g))) for g in "xyz"])
            for g, mid in mids.items():
                want |= {(d, g, k): v for k, v in fill(mid, [(r[2], r[6], 2.0 * r[3]) for r in rows if r[:2] == (d, g)]).items()}
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, share, epochs).collect()}
        assert got == {k: int(v + 1e-6) for k, v in want.items()}


def test_mixing_epochs_and_ties(spark, docs):
    taken = mixing.select(docs, share=1.5, epochs=2).collect()
    assert all(1 <= r.epochs <= 2 for r in taken)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() >= len(taken) - 2
    assert line_dedup.clean(docs).columns == docs.columns and {r.n_lines for r in line_dedup.clean(docs).select("n_lines").collect()} == {"n_lines"}


def test_gif_round_trip_and_features(spark, docs):
    got = by_id(gif.digest(docs))
    for i, t in EDGES:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    media = gif.write_texts(docs)
    rows = gif.read_frames(media, "doc_id", "gif").where("media_id = 14").sort("frame").collect()
    assert len(rows) == 2 and rows[1].start_ms == 100 and sum(rows[0].red_hist) == 192 * 64
    stored = {r.doc_id: bytes(r.gif) for r in media.collect() if r.doc_id is not None}
    for i, t in EDGES:
        raw = (t or "").encode()
        bins = np.bincount(np.frombuffer(raw.ljust(max(1, -(-len(raw) // 192)) * 192), np.uint8) >> 4, minlength=16).tolist()
        n = max(1, -(-len(raw) // (192 * 64)))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert got[i].feature == f"frames={n};ms={100 * n};hist={','.join(map(str, bins))}"
    whole = stored[6]
    cuts = [whole[:n] for n in (*range(0, 900, 7), len(whole) - 1)] + [whole[:6] + b"\xff" * 4 + whole[10:], b"GIF89a" + bytes(4) + whole[10:]]
    bad = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(cuts)] + [(None, None)], "doc_id long, gif binary")
    found = gif.read_frames(bad, "doc_id", "gif").collect()
    assert {r.media_id for r in found if r.error} == {*range(len(cuts)), None}
    broken = media.where("doc_id = 14").select("doc_id", F.expr("substring(gif, 1, octet_length(gif) - 900)").alias("gif"))
    assert [r.error is None for r in gif.read_frames(broken, "doc_id", "gif").sort("frame").collect()] == [True, False]


def test_gif_disposal_transparency_and_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def image(pixels, disposal, transparent=None, flags=0, rect=(0, 0, 2, 2)):
        code = gif.lzw_encode(bytes(pixels), 2)
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0])
        x, y, w, h = rect
        return control + b"," + np.array([x, y, w, h], "<u2").tobytes() + bytes([flags, 2, len(code)]) + code + b"\0"

    head = b"GIF89a" + np.array([2, 2], "<u2").tobytes() + bytes([0x81, 0, 0]) + palette
    data = head + image([1, 1, 1, 1], 1) + image([2, 0, 0, 2], 3, 0) + image([3], 2, rect=(1, 1, 1, 1)) + image([0, 0, 0, 2], 1, 0) + b";"
    shown = [(f.start_ms, f.canvas[..., :3].tolist(), f.canvas[..., 3].tolist()) for f in gif.frames(data)]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert [s[0] for s in shown] == [0, 50, 100, 150]
    assert shown[1][1] == [[green, red], [red, green]] and shown[2][1] == [[red, red], [red, blue]]
    assert shown[3][1][1][1] == green and shown[3][1][0][0] == red
    for n in (1, 5, 4000, 70000):
        raw = RNG.integers(0, 256, n).astype(np.uint8).tobytes()
        assert gif.lzw_decode(gif.lzw_encode(raw), 8, n) == raw


def test_simhash_against_all_pairs(spark, docs):
    prints = {}
    for i, t in EDGES:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}
    for _ in root:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    got = by_id(simhash.group(docs))
    assert {i: (got[i].fp % (1 << 64), got[i].component_id) for i in prints} == {i: (prints[i], root[i]) for i in prints}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([*{root[i] for i in root}, None], key=str)


def test_simhash_tiles_find_every_pair(spark):
    base = RNG.integers(0, 2**63, 300)
    near_ones = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base[:150] for a, b in [RNG.integers(0, 63, 2)]]
    values = list(dict.fromkeys([*map(int, base), *near_ones]))
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2}
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    got = [tuple(sorted((r.a, r.b))) for r in simhash.links(nodes, tile=2).collect()]
    assert set(got) == want and len(got) == len(want)


def test_bpe_whole_and_in_pieces(spark, docs):
    path = public_tokenizers.path(bpe.RANK_FILE)
    coder = bpe.encoding(path, public_tokenizers.PATTERN)
    hard = "don't we'll  x\n\n 12ab3,'s é漢字!!  \t" * 3000 + " " * 5000 + "a" * 40000
    assert bpe.encode(coder, hard) == coder.encode_ordinary(hard)
    assert len(list(bpe.pieces(hard))) > 1 and "".join(bpe.pieces(hard)) == hard
    got = by_id(bpe.digest(docs, path))
    for i, t in EDGES:
        ids = coder.encode_ordinary(t or "")
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect() if r.doc_id is not None} == {i: t or "" for i, t in EDGES}


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for _ in range(150):
        v = rng.integers(0, int(rng.integers(2, 30)), int(rng.integers(0, 50))).astype(np.uint64)
        least, want = int(rng.integers(1, 8)), set()
        for c in np.flatnonzero(v).tolist():
            left = right = c
            while left > 0 and v[left - 1] > v[c]:
                left -= 1
            while right < len(v) - 1 and v[right + 1] >= v[c]:
                right += 1
            if right - left + 1 >= least:
                want.add((c, left, right))
        assert set(zip(*(x.tolist() for x in compact_windows.compact(v, least)))) == want


def test_passages_are_linked_and_others_not(spark, docs):
    got = by_id(compact_windows.classes(docs))
    assert got[6].class_id == got[7].class_id == 6 and got[5].class_id == got[9].class_id == 5
    assert all(got[i].n_links == 0 for i in (0, 1, 2, 3, 11, 14)) and got[None].class_id is None
    words = PASSAGE.split()
    words[20] = "changed"
    edited = spark.createDataFrame([(1, f"{prose(50)} {PASSAGE} {prose(50)}"), (2, f"{prose(50)} {' '.join(words)} {prose(50)}")], "doc_id long, text string")
    assert {r.class_id for r in compact_windows.classes(edited).collect()} == {1}


PAGE = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header><p>site</p></header><nav><a href="/">menu</a></nav>
<{tag}><h1>Title &amp; more</h1><p>First para of it goes on.<div class="advert">buy</div><p>Second   para<br>&lt;here&gt;</p><form>mail</form></{end}>
<section id="comments"><p>nice one, thanks for writing all of this</p></section><footer>&copy; me</footer></body></html>"""


def test_attributes_are_names_and_values():
    w = html_extract.Weights({}, {})
    for attributes in ('style="overflow:hidden"', "title='a hidden gem'", 'data-id="comments-12"', 'data-class="menu"', "onclick=\"x = 'hidden'\"", "hiddenness", 'class=story'):
        assert html_extract.extract(f"<div {attributes}><p>some words of a text</p></div>", w) == "some words of a text"
    for attributes in ("hidden", 'class="story menu"', "id=comments-12", 'style="display: none"', "aria-hidden=true", "role='navigation'"):
        assert html_extract.extract(f"<p>first of it</p><div {attributes}><p>some words</p></div><p>more of it</p>", w) == "first of it\n\nmore of it"
    # Names alone don't empty a page; what isn't shown stays out.
    assert html_extract.extract('<div class="notice-of-intent"><p>all the words</p><nav>menu</nav></div>', w) == "all the words"


def test_the_run_is_the_best_of_all_runs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        page = "".join(f"<{t}>{' '.join('w' * int(rng.integers(1, 9)))}</{t}>" if rng.random() < 0.8 else f'<ul><li><a href="x">{"link " * int(rng.integers(1, 9))}</a></li></ul>' for t in rng.choice(["p", "h2", "div"], int(rng.integers(1, 9))))
        w = html_extract.Weights({"p": 1.0, "h": 0.5, "div": -0.7, "li/link": -1.0}, {"ul": -0.5, "p": -0.05})
        found = html_extract.blocks(page)
        score = [len(b.text.split()) * w.word(b.kind) + sum(map(w.tag, b.tags)) for b in found]
        runs = [(sum(score[i:k]), "\n\n".join(b.text for b in found[i:k])) for i in range(len(found)) for k in range(i + 1, len(found) + 1)]
        top = max([s for s, _ in runs] + [0.0])
        text = html_extract.extract(page, w)
        assert any(abs(s - top) < 1e-9 and t == text for s, t in [*runs, (0.0, "")])


def test_text_is_the_same_without_the_mark(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    w = html_extract.train(pages)
    htmls = [r.html for r in pages.collect()]
    hidden = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h) for h in htmls]
    same = sum(html_extract.extract(a, w) == html_extract.extract(b, w) for a, b in zip(htmls, hidden))
    assert same >= 0.95 * len(htmls)


@pytest.mark.parametrize("tag", ["article", 'div class="post"'])
def test_main_text(tag):
    w = html_extract.weights(sum((html_extract.counts(PAGE.format(tag="article", end="article")) for _ in range(5)), collections.Counter()))
    text = html_extract.extract(PAGE.format(tag=tag, end=tag.split()[0]), w)
    assert text == "Title & more\n\nFirst para of it goes on.\n\nSecond para <here>"
    assert html_extract.extract("", w) == "" and html_extract.extract("<p>cut off <b", w) == "cut off"


def test_pages_on_the_tables(spark):
    rows = registry.queries()["op10_html"](spark, DATA).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extract_pages(odd, html_extract.Weights({}, {})).collect()) == ["", "", "x"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over a small table, each repeated in plain Python."""
    rng = np.random.default_rng(9)
    base = [f"{prose(int(rng.integers(55, 80)))}\nshared line of the site {k % 3}\n{prose(12)}" for k in range(14)]
    rows = [(i, base[i % 14] if i < 20 else base[i % 14].replace(" ", " changed ", 1), "en" if i % 3 else "de", f"src{i % 4}") for i in range(28)]
    rows += [(40, "too short", "en", "src1"), (41, "# " * 60, "en", "src2"), (42, None, "en", "src1")]
    rows = [(i, t, g, h, len(t or "")) for i, t, g, h in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    # 1. Rules; with so few hosts of like rates no host is rejected.
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    kept = {i: [t, g, h] for i, t, g, h, _ in rows if len(words(t)) >= 50 and not t.startswith("#")}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()} == set(kept)
    # 2. Lines like an earlier one.
    seen = []
    for i in sorted(kept):
        left = []
        for line in kept[i][0].split("\n"):
            w = words(line)
            gone = any(w == x or min(len(w), len(x)) >= 5 and near(x, w) for x in seen)
            seen.append(w)
            if not gone or not w:
                left.append(line)
        kept[i][0] = "\n".join(left)
    # 3. One of each group of fingerprints.
    prints = {i: simhash.fingerprint(x[0]) % (1 << 64) for i, x in kept.items()}
    root = {i: i for i in prints}
    for _ in root:
        for a, b in itertools.combinations(sorted(prints), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    kept = {i: x for i, x in kept.items() if root[i] == i}
    # 4. Budgets by weight, whole epochs, then the longest prefix in the order of a hash.
    domain = {i: int(re.search(r"[0-9]+$", x[2])[0]) % 4 for i, x in kept.items()}
    tokens = {i: len(words(x[0])) for i, x in kept.items()}
    leaf = {i: (domain[i], x[1], x[2]) for i, x in kept.items()}
    size = collections.Counter()
    for i in kept:
        size[leaf[i]] += tokens[i]
    some = lambda k, v: {x for x in size if x[k] == v}
    taken = []
    tops = fill(mixing.BUDGET * sum(size.values()), [(d, float(mixing.DOMAIN_WEIGHTS[d]), 2.0 * sum(size[x] for x in some(0, d))) for d in sorted({x[0] for x in size})])
    for d, top in tops.items():
        mids = fill(top, [(g, float(mixing.LANG_WEIGHTS[g]), 2.0 * sum(size[x] for x in some(0, d) & some(1, g))) for g in sorted({x[1] for x in some(0, d)})])
        for g, mid in mids.items():
            for s, low in fill(mid, [(x[2], 1.0, 2.0 * size[x]) for x in sorted(some(0, d) & some(1, g))]).items():
                whole, rest = divmod(int(low + 1e-6), size[d, g, s]) if size[d, g, s] else (0, 0)
                members = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{i}".encode()).hexdigest(), i) for i in kept if leaf[i] == (d, g, s))
                upto = 0
                for _, i in members:
                    upto += tokens[i]
                    taken += [i] * (whole + (upto <= rest))
    # 5. Token ids.
    coder = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    want = sorted((i, hashlib.sha256(" ".join(map(str, coder.encode_ordinary(kept[i][0]))).encode()).hexdigest()) for i in taken)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want and len(want) > 3


def test_pipeline_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdicts = {r.doc_id for r in registry.queries()["op3_host_quality"](spark, DATA).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == verdicts
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_many_rejected_hosts_are_joined_in_parts(spark, docs, monkeypatch):
    few = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 0)
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == few
