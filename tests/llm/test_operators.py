import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonalith.llm import html, linededup, lm, mixing, packing, pii, quality, simhash, topk
from zonalith.llm.components import components
from zonalith.llm.store import TokenStore
from zonalith.llm.tokens import Encoder

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", "of", "and", "Erntion", "thble", "onré", "x@y.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "ñ", "#", "|", "\n", "\n\n", " ", "  ", "\t", "12", "世界", "'s", "."]


def texts(n, seed=7):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    return [*out, None, "", "   \n ", out[0], out[0] + " end", "a " * 3000, "word"]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 % 101, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts(60))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with an extra column whose name an operator uses inside."""
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_is_exact(path):
    own = Encoder(path, most=50)
    rng = random.Random(1)
    odd = ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "é", "'s", ".", "|", "\xa0", "\x0b", "\x1c", "9", "I", "\0", "世", "́", "<|endoftext|>"]) for _ in range(rng.randrange(30))) for _ in range(800)]
    found = [t or "" for t in texts(50)] + odd
    assert own(found) == own._direct(found)


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_of_columns(path):
    """Nulls, empty and long texts, slices, and columns of either string type."""
    own = Encoder(path)
    assert [x.tolist() for x in own.closed(pa.array([], pa.string()), 7)] == [[], []]
    assert [x.tolist() for x in own.closed(pa.array([None, ""], pa.string()), 7)] == [[7, 7], [1, 2]]
    found = ["not in the slice", None, "", "a b", " ", " x", "  ", "Hello, World!  It's 3.5%\n", "x" * 100_000, None, "é. É, ñ; Ünï×.", ""]
    for kind in (pa.string(), pa.large_string()):
        ids, ends = own.closed(pa.array(found, kind).slice(1), 7)
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [ids_of(path, t, 7) for t in found[1:]]


def test_store_round_trip(spark, docs, rows, empty):
    store = TokenStore.write(docs, WORD_BPE)
    found = sorted(store.summaries(spark).collect(), key=lambda r: r["start"])
    back = {r["start"]: r["ids"] for r in store.read(spark).collect()}
    at = 0
    for r, (doc, text, *_) in zip(found, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = ids_of(WORD_BPE, text, 1)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["verified"]) == (doc, at, len(ids), True)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and back[at] == ids
        at += len(ids)
    chunks = [r["digest"] for r in store.chunks(spark).collect()]
    assert len(chunks) == len(set(chunks)) < sum(r["n_chunks"] for r in found)
    assert store.verify(spark)
    assert TokenStore.write(empty, WORD_BPE).summaries(spark).count() == 0


def test_packing(docs, rows, empty):
    found = packing.pack(docs, BYTE_BPE, capacity=64).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        ids = ids_of(BYTE_BPE, text, 2)
        at = 0
        while at < len(ids):
            to = at + ((len(ids) - at) % 64 or 64)
            expected[doc, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at = to
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    assert len(bins) <= 1.1 * math.ceil(sum(r["length"] for r in found) / 64) + 1
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_best_two_fit_swaps_and_conserves():
    assert packing.patterns({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [([60, 25, 15], 1), ([30], 1)]
    rng = random.Random(2)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        left = Counter()
        for own, times in packing.patterns(counts, 64):
            assert sum(own) <= 64
            for n in own:
                left[n] += times
        assert left == counts


def test_mix(docs, rows, empty):
    found = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((d, len((t or "").encode().split())) for d, t, *_ in rows)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, found))
    assert mixing.mix(empty).count() == 0


def test_targets_are_shared_again_above_the_cap():
    found = {s: a / b for s, (a, b) in mixing.targets({"a": 1000, "b": 10, None: 10}).items()}
    assert found == {"a": 960.0, "b": 30.0, None: 30.0}
    assert mixing.targets({"a": 0}) == {"a": (0, 1)}


def test_quality(docs, rows, empty):
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect())
    expected = Counter()
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        threes = Counter(zip(words, words[1:], words[2:], strict=False))
        repeat = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        expected[doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)] += 1
    assert found == expected
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).filter("kept").count()
    assert quality.judge(empty).count() == 0


def test_references_of_many_languages(spark, docs, rows):
    """The same verdicts whether references are sent or joined."""
    order = lambda df: sorted(map(str, df.collect()))
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("l"), F.col("doc_id") % 7)))
    assert order(quality.judge(many)) == order(quality.judge(many, known=0))
    assert order(quality.keep_good(many)) == order(quality.keep_good(many, known=0))
    assert quality.judge(many.limit(0), known=0).count() == quality.judge(many.limit(0)).count() == 0


def test_divergence():
    assert quality.js(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1) and quality.js(np.array([1, 3]), np.array([2, 6])) == 0


def test_simhash_against_brute_force(spark, empty):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = [int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for c in centres for _ in range(40)]
    fps = sorted(set(prints))
    from zonalith.llm import hamming

    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    for most in (5, 2048):
        found = {r["node"]: r["root"] for r in components(hamming.links(spark.createDataFrame(signed, "fp long"), simhash.bk_search, 3, most)).collect()}
        label = {f: f for (f,) in signed}
        values = np.array([f for (f,) in signed])
        near = [np.flatnonzero(np.bitwise_count(values.view(np.uint64) ^ v) <= 3) for v in values.view(np.uint64)]
        lab = values.copy()
        for _ in range(len(values)):
            new = np.array([lab[n].min() for n in near])
            if (new == lab).all():
                break
            lab = new
        assert all(found.get(f, f) == r for f, r in zip(values.tolist(), lab.tolist(), strict=True)) and label


def test_near_duplicates(docs, rows, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {(r["doc_id"], r["fingerprint"]) for r in found}
    assert by == {(d, f"{simhash.fingerprint((t or '').encode()):016x}") for d, t, *_ in rows}
    blank = [d for d, t, *_ in rows if not (t or "").split()]
    assert {r["component_id"] for r in found if r["doc_id"] in blank} == {min(blank)}
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_bit_by_bit():
    import xxhash

    for text in ("a b c d e", "A b", "", "x y z x y z"):
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_line_dedup_against_brute_force(spark, empty):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["erntion", "thble", "onred", "ingthe", "of", "the", "esand", "orwhin"]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    lines = [b if rng.random() < 0.5 else b.replace("a", "e", 1) + rng.choice(["", ".", " now"]) for b in base for _ in range(4)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(40)] + [(90, None), (91, ""), (92, "\n \n"), (None, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["line"]): r["keep"] for r in linededup.line_decisions(docs, most=16).collect()}
    each = [(d, i, linededup.normalised(x.encode())) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()]
    label = list(range(len(each)))
    for i in range(len(each)):
        for j in range(i):
            a, b = each[i][2], each[j][2]
            if a == b or linededup.similar(a.decode(), b.decode(), 0.8):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    first = {}
    for k, (d, i, _) in zip(label, each, strict=True):
        first[k] = min(first.get(k, (10**9, 0)), (-1 if d is None else d, i))
    assert found == {(d, i): first[k] == (-1 if d is None else d, i) for k, (d, i, _) in zip(label, each, strict=True)}
    per = {r["doc_id"]: r for r in linededup.line_dedup(docs).collect()}
    assert (per[90]["n_lines"], per[90]["n_kept"], per[90]["removed"]) == (0, 0, "")
    cleaned = {r["doc_id"]: r["text"] for r in linededup.without_copies(docs).collect()}
    assert cleaned[90] is None and cleaned[91] == "" and len(cleaned) == len(rows)
    assert linededup.line_dedup(empty).count() == 0


def test_line_dedup_reaches_edit_similarity(spark):
    """Against a brute force by edit similarity, on lines of few and of many words with some of them changed: no false link, nearly all true ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    lines = []
    for n in [5, 8, 12, 16, 20, 24, 28, 35, 45, 60, 90, 150] * 2:
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for share in (0.05, 0.1, 0.15):
            lines.append(" ".join(word() if k in rng.sample(range(n), max(1, int(share * n))) else w for k, w in enumerate(base)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if linededup.similar(lines[i], lines[j], 0.8):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    kept = {r["doc_id"] for r in linededup.line_dedup(docs).collect() if r["n_kept"]}
    assert kept >= set(label)
    assert len(lines) - len(kept) >= 0.95 * (len(lines) - len(set(label)))


def test_line_dedup_of_repeated_ids(spark):
    """Rows that share a doc_id, or have none, but differ in text lose only copies."""
    rows = [(None, "u\ndup"), (None, "dup\nunique"), (7, "one alone\nsame here"), (7, "same here\nanother text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(x for r in linededup.without_copies(docs).collect() for x in r["text"].split("\n") if x)
    assert left == Counter(["u", "dup", "unique", "one alone", "same here", "another text"])


def test_edit_distance():
    assert [linededup.edit_distance(*p) for p in (("kitten", "sitting"), ("", "abc"), ("abc", "abc"), ("abcdef", "azced"))] == [3, 3, 0, 3]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<script>var a = "<!--";</script><article><p>Hello there <b>world</b>.</p></article></body>', "Hello there world."),
        ("<style>a > b { content: '<!--' }</style><article><p>One.</p><script>if (a<b) {}</script><p>Two.</p></article>", "One.\nTwo."),
        ('<article><p>The <span class="alert">very</span> end.</p></article>', "The very end."),
        ('<article><p>In <span class="note"><span>an inner</span> one</span> here.</p><p><span class="ad">Buy now</span></p></article>', "In an inner one here."),
        ('<article><div class="side-by-side"><p>Real paragraph of the article, as long as this.</p></div></article>', "Real paragraph of the article, as long as this."),
        ('<body class="has-sidebar"><article><p>A paragraph of the article.</p></article><div class="left-sidebar"><p>Not this one.</p></div></body>', "A paragraph of the article."),
        ("<article><p>Open <b>bold<p>Next, with <i>both</b></i> here.</article>", "Open bold\nNext, with both here."),
        ("<article><textarea>no</textarea><p>a &lt;b&gt; &amp;amp; c&nbsp;d\n  e</p></article>", "a <b> &amp; c d e"),
        ("<article><p>Kept.</p><script>never closed <p>lost</p>", "Kept."),
    ],
)
def test_html_markup(page, text):
    assert html.main_text(page, html.default_tree()) == text


def test_html_of_awkward_tables(spark):
    """Very long pages, repeated rows, null ids, extra columns and no rows at all."""
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", long, 1), (1, "u", long, 1), (None, None, None, 2), (3, "v", "", 3)], "page_id long, url string, html string, text int")
    found = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert found[1]["text"].count("\n") == 19_999 and found[None]["text"] == found[3]["text"] == "" and html.extract(pages).count() == 4
    assert html.extract(pages.limit(0)).count() == 0


def test_html_pages(spark):
    tree = html.default_tree()
    page = "<html><body><header><h1>Site</h1></header><nav><li><a href=x>Home</a></nav><main><header><h1>Title</h1></header><p>Text &amp; <b>o</b>ne <a href='x'>link</a>.<p>Two\n lines<aside>note</aside><form>Mail</form><script>var x='</p>'</script><section class='comments'><p>Nice</p></section></main><div class='cookie-notice'>ok</div><footer>&copy;</footer>"
    assert html.main_text(page, tree) == "Title\nText & one link.\nTwo lines"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "a &lt; b <!-- cut"), (5, "x", "<article><p>One<p>To.</p><a hre"), (1, "u", page)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in found][1:5] == [(2, "", 0), (3, "", 0), (None, "a < b", 5), (5, "One\nTo.", 7)]
    table = np.array(html.LABELLED, float)
    assert np.mean([html.classify([html.Block(1)], tree) == [False]]) in (0.0, 1.0) and len(table) > 48


def base_spans(t):
    out, n = [], Counter()
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
                n[kind] += 1
    return n, ",".join(f"{a[3]}:{a[0]}:{a[2]}" for a in sorted(out))


def test_personal_data(spark, rows, empty):
    rng = random.Random(5)
    odd = ["".join(rng.choice(["a", ".", "@", "1", "4", "+", "-", " ", "(", ")", "_", "é", "%", "255", "1.2.3.4", "4111111111111111", "x@y.z", "\n", "世"]) for _ in range(rng.randrange(60))) for _ in range(800)]
    own = [*odd, None, "", "a@" + "b." * 3000, "1 " * 5000, "1" * 4000, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"', *(r[1] for r in rows)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert len(found) == len(own)
    for i, t in enumerate(own):
        n, spans = base_spans(t or "")
        r = found[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [n[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
    assert pii.find(empty).count() == 0


def test_personal_data_of_long_texts(spark):
    """More matches than a run of places, in one text; repeated rows and null ids."""
    text = " ".join(f"user{i}@host{i}.org 10.0.{i % 256}.7" for i in range(1500)) + " ünd a@b.de"
    found = pii.find(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    expected = [(m.start(), k, m.end()) for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"\b[0-9]+(\.[0-9]+){3}\b")) for m in re.finditer(p, text)]
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in sorted(expected)).encode()).hexdigest()
    assert len(found) == 3 and all((r["n_email"], r["n_ip"], r["base_sha256"]) == (1501, 1500, digest) and r["n_spans"] >= 3001 for r in found)


def test_reliabilities_find_the_better_labeler():
    rng, counts = random.Random(6), Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = [2 * (y if rng.random() < p else not y) for p in (0.95, 0.9, 0.85, 0.8, 0.55)]
        counts[sum(v * 3**i for i, v in enumerate(votes))] += 1
    _, table = pii.reliabilities(counts)
    right = [(own[1][2] + own[0][0]) / 2 for own in table]
    assert right[0] > 0.9 and right[4] < 0.65


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(180)] + [(200, None), (250, [1.0, None, 0.0]), (300, [float("nan")] * 6), (301, [0.5] * 6), (302, [0.5] * 6), (None, [1.0] * 6), (400, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.pad(np.floor(256 * np.array(x)), (0, 6 - len(x))) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    expected = []
    for q in (i for i in v if i % 50 == 0):
        ranked = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)
    assert topk.top_k(df.filter("vec_id in (50, 60, 61)")).count() == 2 and topk.top_k(df.limit(0)).count() == 0


def test_language_model(docs, rows, empty):
    c = Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 10:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for d, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected[d, zlib.crc32(str(d).encode()) % 10 == 0, len(words), sum(c[w] > 0 for w in words), n, round(base, 4)] += 1
    found = lm.score(docs, lm.Shape(head=8)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm.score(empty).count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(9)
    model = lm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    seq = [1, 3, 2, 0]
    total = 0.0
    for path in np.ndindex(*[2] * 4):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
    for _, sizes, steps in lm._padded([np.array(seq), np.array([0])]):
        assert lm.forward(model, sizes, steps)[2][0] == pytest.approx(math.log(total))


def test_hmm_works_on_several_batches_at_once():
    """Rows and their order stay, small batches are joined up to AT_ONCE bytes, and a score does not depend on how rows are dealt."""
    rng = np.random.default_rng(8)
    symbols = [rng.integers(0, 9, n).astype("<i4").tobytes() for n in rng.integers(1, 40, 50)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(symbols, pa.binary())], names=["row", "symbols"])
    parts = [whole.slice(i, 7) for i in range(0, 50, 7)]
    (one,) = lm._several(iter(parts))
    assert one.to_pylist() == whole.to_pylist() and list(lm._several(iter([]))) == []
    model = lm.Model(*(x / x.sum(axis=k, keepdims=True) for x, k in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((9, 3)), 0))))
    shared = type("Shared", (), {"value": model})
    scores = [r for b in lm._Score(shared)(iter(parts)) for r in b.to_pylist()]
    alone = [r for p in range(50) for b in lm._Score(shared)(iter([whole.slice(p, 1)])) for r in b.to_pylist()]
    assert [r["row"] for r in scores] == list(range(50)) and np.allclose([r["score"] for r in scores], [r["score"] for r in alone], rtol=1e-12)
