"""The pipeline as a whole against a plain version of each stage, on the small table with awkward rows added."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from zonalith.llm import linededup, mixing, neardocs, quality, simhash

SMALL = "/root/testdata/sf0.001"
EXTRA = ["rank", "fp", "_doc", "_mark", "_gone", "_Row"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = (set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (), set("0123456789"), set(" \t\n\x0b\x0c\r"), set(".,;:!?'\"()-"), set("#*$%&|<>"))


def histograms(text):
    chars, words = [0] * 8, [0] * (len(quality.WORDS) + 1)
    for c in text:
        chars[2 if ord(c) > 127 else next((i for i, own in enumerate(MARKS) if c in own), 7)] += 1
    for w in WORD.findall(text):
        low = w[0].lower() + w[1:]
        words[quality.WORDS.index(low) if low in quality.WORDS else -1] += 1
    return chars, words


def divergence(a, b):
    p, q = [x / (sum(a) or 1) for x in a], [x / (sum(b) or 1) for x in b]
    return sum(x * math.log2(2 * x / (x + y)) / 2 for s, t in ((p, q), (q, p)) for x, y in zip(s, t, strict=True) if x)


def good(docs):
    own = [histograms(d["text"] or "") for d in docs]
    rules, out = quality.Rules(), []
    for d, (chars, words) in zip(docs, own, strict=True):
        same = [h for e, h in zip(docs, own, strict=True) if d["lang"] in (None, e["lang"])]
        tokens = WORD.findall(d["text"] or "")
        threes = Counter(zip(tokens, tokens[1:], tokens[2:], strict=False))
        repeat = {i + k for i in range(len(tokens) - 2) if threes[tuple(tokens[i : i + 3])] > 1 for k in range(3)}
        if len(tokens) < 50 or 2 * len(repeat) > len(tokens):
            continue
        if sum(chars) >= rules.least_chars and divergence(chars, [sum(h[0][i] for h in same) for i in range(8)]) ** 0.5 > rules.most_char_js:
            continue
        if divergence(words, [sum(h[1][i] for h in same) for i in range(len(words))]) <= rules.most_word_js**2 + rules.word_slack / len(tokens):
            out.append(d)
    return out


def groups(n, linked):
    """The smallest position of each connected group."""
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in linked:
        low, high = sorted((find(i), find(j)))
        top[high] = low
    return [find(i) for i in range(n)]


def alike(lines):
    """All pairs of edit similarity 0.8."""
    size = np.array([len(x) for x in lines])
    chars = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in lines])
    for i in range(len(lines)):
        longer = np.maximum(size[i + 1 :], size[i])
        both = np.minimum(chars[i + 1 :], chars[i]).sum(axis=1)  # an edit takes one common character at most
        for j in np.flatnonzero(both >= 0.8 * longer - 1e-9) + i + 1:
            if linededup.similar(lines[i], lines[j], 0.8):
                yield i, int(j)


def without_lines(docs):
    lines = sorted((d["doc_id"] is not None, d["doc_id"] or 0, i, linededup.normalised(x.encode())) for d in docs for i, x in enumerate((d["text"] or "").split("\n")) if WORD.search(x))
    first = {}
    for k, (*_, x) in enumerate(lines):
        first.setdefault(x, k)
    kinds = list(first)
    root = groups(len(kinds), alike([x.decode() for x in kinds]))
    kept = {lines[first[kinds[i]]][:3] for i in set(root)}
    out = []
    for d in docs:
        def stays(i, x, d=d):
            return not WORD.search(x) or (d["doc_id"] is not None, d["doc_id"] or 0, i) in kept

        text = None if d["text"] is None else "\n".join(x for i, x in enumerate(d["text"].split("\n")) if stays(i, x))
        out.append(d | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def one_of_each(docs):
    docs = sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0))
    own = []
    for d in docs:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")
        words = WORD.findall(words)
        own.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    linked = ((i, j) for i in range(len(docs)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) - 1e-9)
    return [docs[i] for i in sorted(set(groups(len(docs), linked)))]


def copies(docs):
    size = [len(WORD.findall(d["text"] or "")) for d in docs]
    total = Counter()
    for d, n in zip(docs, size, strict=True):
        total[d["source"]] += n
    goal = mixing.targets(total)

    def key(i):
        text = docs[i]["text"] or ""
        u = (int(hashlib.md5(str(docs[i]["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / max(0.05, (1 - len(re.findall(r"[#*$%&|<>]", text)) / max(1, len(text))) ** 2)

    out, before = [], Counter()
    for i in sorted(range(len(docs)), key=key):
        source = docs[i]["source"]
        target = goal[source][0] / goal[source][1]
        whole = target // total[source]
        more = 2 * before[source] + size[i] <= 2 * (target - whole * total[source])
        before[source] += size[i]
        out += [docs[i]] * int(whole + more)
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The small documents with null texts, languages, sources and counts, exact copies, and extra columns that operators use inside."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    long = [r for r in rows if len((r["text"] or "").split()) > 150]
    extra = [long[0] | {"doc_id": 10**9}, long[1] | {"doc_id": 10**9 + 1, "source": None, "lang": None}, long[2] | {"doc_id": 10**9 + 2, "text": None, "n_chars": None}, long[3] | {"doc_id": 10**9 + 3, "text": "", "n_chars": 0}]
    path = tmp_path_factory.mktemp("pipeline")
    made = spark.createDataFrame([(*(r[c] for c in docs.columns), i, *"xxxxx") for i, r in enumerate(rows + extra)], [*docs.columns, *EXTRA])
    made = made.select(*[made[f.name].cast(f.dataType) for f in docs.schema], *EXTRA)
    made.repartition(3).write.parquet(f"{path}/documents.parquet")
    made.limit(0).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def order(d):
    return d["doc_id"], d["text"] or "", d["n_chars"] or 0


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Every stage on what the stage before kept, and run() on the whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, plain = docs.columns, rows_of(docs)
    for (name, stage), version in zip(corpus_pipeline.STAGES[:-1], (good, without_lines, one_of_each, copies), strict=True):
        before = plain
        docs, plain = stage(spark, docs, sf_dir), version(before)
        assert docs.columns == columns, name
        assert sorted(rows_of(docs), key=order) == sorted(plain, key=order), name
        assert name in ("line_dedup", "source_mix") or len(plain) < len(before), name
        docs = spark.createDataFrame([tuple(d[c] for c in columns) for d in plain], docs.schema).repartition(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for d in plain:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            expected[d["doc_id"], at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(bins) <= 1.05 * math.ceil(sum(r["length"] for r in found) / 1024) + 1


def test_pipeline_of_nothing(spark, sf_dir):
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0


def test_near_dedup_loses_no_text(spark):
    """Rows that share a doc_id, or have none, but differ in text are documents of their own."""
    a, b, c = ("the quick brown fox jumps over it", "nothing in this line is like the others at all", "a third text that stands alone here today")
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, a), (2, None), (3, ""), (None, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (0, c), (2, None)], key=str)


def test_near_dedup_by_shingles(spark):
    """Against a brute force by the Jaccard similarity of five words."""
    rng = np.random.default_rng(5)
    texts = []
    for n in (40, 60, 100, 200, 400):
        base = [f"w{k}" for k in rng.integers(0, 10**6, n)]
        for edits in (0, 1, n // 100, n // 40, n // 20):
            own = list(base)
            for k in rng.integers(0, n, edits):
                own[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(groups(len(texts), linked))


def test_near_dedup_searches_simhashes_in_trees(monkeypatch):
    """SimHashes bit by bit; pairs tested are those that the BK-trees have within reach, also in parts of a shard; all of similarity 0.8 are linked."""
    rng = np.random.default_rng(7)
    texts = ["", "one", "two words"]
    for n in (9, 12, 30, 90, 300):
        base = [f"w{k}" for k in rng.integers(0, 10**6, n)]
        for edits in (0, 1, 1, 2, n // 30, n // 10):
            own = list(base)
            for k in rng.integers(0, n, edits):
                own[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    hashes, counts = neardocs.shingles([t.encode() for t in texts], 5)
    sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(counts)[:-1])]
    fp = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)) for own in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int64())], names=["text", "h"])
    assert next(neardocs._Keys(5)(batch))[2].tolist() == fp
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= neardocs.reach(0.8)}
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]}
    assert linked <= near and 30 <= len(near) < len(texts) * (len(texts) - 1) // 2
    for side in ([0] * len(texts), [1 + k % 2 for k in range(len(texts))]):
        met = {(min(x), max(x)) for x in near if side[x[0]] == 0 or side[x[0]] != side[x[1]]}
        rows = pa.RecordBatch.from_arrays([pa.array([5] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(side, pa.int32()), pa.array(texts)], names=["shard", "h", "root", "side", "text"])
        found, plain = [], simhash.BKTrees.within_wide

        def seen(self, *args, found=found, side=side):
            stored, asked = [k for k, s in enumerate(side) if s != 2], [k for k, s in enumerate(side) if s != 1]
            for node, query in plain(self, *args):
                found.extend((stored[x], asked[y]) for x, y in zip(node.tolist(), query.tolist(), strict=True))
                yield node, query

        monkeypatch.setattr(simhash.BKTrees, "within_wide", seen)
        links = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for b in neardocs._Alike(0.8, 5)(iter([rows])) for r in b.to_pylist()}
        monkeypatch.setattr(simhash.BKTrees, "within_wide", plain)
        assert {(min(x), max(x)) for x in found if x[0] != x[1]} == met
        assert links <= linked and groups(len(texts), links) == groups(len(texts), linked & met)
