"""Each operator against a plain version on small tables, and on odd and empty tables."""

import base64
import gzip
import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from vigil.llm import bpe, ctw, embeddings, graphs, jaccard, packing, quality, queries, substrings, toxicity, unigram, warc
from vigil.llm import words as wd

WORD = re.compile("[^\x20\x09-\x0d]+")


def split(text):
    return WORD.findall(text or "")


# --- op1 ---


@pytest.fixture(scope="module")
def vocabulary():
    raw = queries._vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(raw)
    return raw, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(vocabulary):
    _, ranks, library = vocabulary
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    rng = random.Random(1)
    letters = [chr(c) for c in range(1, 0x250)] + list("  \n\n\t\r\x1c\x85\xa0''''sdtrevml012 　漢字かな한국어😀é")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500 + "x" + "\n" * 99, "", "'s't're"]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_streaming_decode_waits_for_whole_characters(vocabulary):
    _, ranks, library = vocabulary
    decoder = bpe.Decoder(ranks)
    ids = [ranks[bytes([b])] for b in "é😀漢".encode()]
    out = list(decoder.feed(ids))
    assert [x.decode() for x in out] == ["é", "😀", "漢"] and decoder.finish() == b""


def test_bpe_on_odd_and_empty(vocabulary, odd_docs, no_docs):
    raw, _, library = vocabulary
    rows = bpe.digests(odd_docs, raw, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_tokens == 0 and by_id[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[11].decoded_sha256 == hashlib.sha256(b"a" * 50_000).hexdigest()
    assert bpe.digests(no_docs, raw, public_tokenizers.PATTERN).count() == 0
    both = bpe.decoded(bpe.encoded(odd_docs, raw, public_tokenizers.PATTERN), raw, public_tokenizers.PATTERN).collect()
    assert all(r.decoded == (r.text or "") for r in both)


# --- op2 ---


def plain_ctw(counts, depth):
    """Context trees by recursion over dictionaries; log2 of a word."""
    trees = defaultdict(lambda: [0, 0])

    def walk(word):
        data = word.encode() if word == "\n" else word.encode() + b" "
        for i, b in enumerate(data):
            before = (b"\0" * depth + b" " + data[:i])[-depth:] if i < depth else data[i - depth : i]
            for k in range(8):
                yield before, (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1

    for word, n in counts.items():
        for context, node, bit in walk(word):
            for d in range(depth + 1):
                trees[context[depth - d :], node][bit] += n
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    weighted, children = {}, defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in trees.items():
            if len(context) == d:
                w = kt(a, b) if d == depth else np.logaddexp(kt(a, b), children[context, node]) + math.log(0.5)
                weighted[context, node] = w
                if d:
                    children[context[1:], node] += w

    def price(word):
        total = 0.0
        for context, node, bit in walk(word):
            p, left, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (context[depth - d :], node)
                if key in trees:
                    a, b = trees[key]
                    own = math.exp(min(math.log(0.5) + kt(a, b) - weighted[key], 0))
                    last = (b + 0.5) / (a + b + 1) if bit else (a + 0.5) / (a + b + 1)
                    p, left = p + left * own * last, left * (1 - own)
            total += math.log2(p + left * last)
        return total

    return price


def check_ctw(df, depth=5):
    rows = df.collect()
    got = ctw.scored(df, ctw.Settings(depth=depth, bucket_bytes=20_000, block_words=500)).collect()
    assert len(got) == len(rows)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update([*split(low(r.text)), "\n"])
    n, v, price = sum(counts.values()), len(counts), plain_ctw(counts, depth)
    wanted = defaultdict(list)
    for r in rows:
        tokens = [*split(low(r.text)), "\n"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        wanted[r.doc_id].append((held(r.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, base, sum(map(price, tokens)) * math.log10(2)))
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5], rel=1e-6) for w in wanted[r.doc_id])


def test_ctw_equals_plain(docs):
    check_ctw(docs.limit(30))


def test_ctw_on_odd_and_empty(odd_docs, no_docs):
    check_ctw(odd_docs.filter("doc_id is null or doc_id <> 11"), 3)
    assert ctw.scored(no_docs).count() == 0


# --- op3 ---


def plain_repeats(rows, k=20):
    seen, out = set(), {}
    for doc, text in rows:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            window = tuple(w[i : i + k])
            if window in seen:
                gone[i : i + k] = [True] * k
            seen.add(window)
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_substrings_equal_plain(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == plain_repeats(rows)


def test_cover_aligns_all_shifts():
    s = substrings.Settings()
    for a in range(s.period):
        for b in range(s.period):
            assert any((a + d) % s.period in s.cover and (b + d) % s.period in s.cover for d in range(s.period))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_substrings_on_odd_and_empty(odd_docs, no_docs, kind):
    """Null ids keep all words; rows that repeat an id are the same document."""
    name = lambda i: i if kind == "long" else f"d{i:05d}"
    df = odd_docs if kind == "long" else odd_docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("d%05d", "doc_id")))
    rows = sorted({(r.doc_id, r.text) for r in odd_docs.filter("doc_id is not null").collect()}, key=lambda r: r[0])
    wanted = {name(i): v for i, v in plain_repeats(rows).items()}
    got = substrings.digests(df).collect()
    assert len(got) == odd_docs.count()
    bare = {sha: (len(w), 0) for w in [split(r.text) for r in odd_docs.filter("doc_id is null").collect()] for sha in [hashlib.sha256(" ".join(w).encode()).hexdigest()]}
    for r in got:
        if r.doc_id is None:
            assert bare[r.kept_sha256] == (r.n_words, r.n_removed)
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id]
    kept = substrings.removed_from(odd_docs, n_chars="n_chars").collect()
    assert len(kept) == odd_docs.count() and kept[0].asDict().keys() == odd_docs.first().asDict().keys()
    assert substrings.digests(no_docs).count() == 0


def test_a_small_filter_changes_nothing(docs):
    small = substrings.Settings(most_bits=1 << 10)
    assert sorted(substrings.digests(docs, small).collect()) == sorted(substrings.digests(docs).collect())


# --- op4 ---


def plain_jaccard(rows, k=5, threshold=0.8):
    sets = {}
    for doc, text in rows:
        w = split(text)
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    links, parent = Counter(), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), links[d], find(d)) for d in ids}


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_equals_plain(docs, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in jaccard.joined(docs, jaccard.Settings(block=block)).collect()}
    assert got == plain_jaccard(rows)


def test_jaccard_on_odd_and_empty(spark, odd_docs, no_docs):
    got = jaccard.joined(odd_docs).collect()
    assert len(got) == odd_docs.count()
    rows = {r.doc_id: r.text for r in odd_docs.filter("doc_id is not null").collect()}
    wanted = plain_jaccard(rows.items())
    assert all((r.n_shingles, r.n_links, r.class_id) == wanted[r.doc_id] for r in got if r.doc_id is not None)
    kept = jaccard.one_of_each(odd_docs)
    assert {r.doc_id for r in kept.collect()} == {d for d, w in wanted.items() if w[2] == d} | {None}
    assert jaccard.joined(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0
    with pytest.raises(TypeError, match="doc_id"):
        jaccard.joined(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_jaccard_takes_one_text_of_a_repeated_id(spark):
    texts = [" ".join(f"w{i}x{j}" for i in range(30)) for j in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[2])]
    seen = set()
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        seen.add(tuple(sorted((r.doc_id, r.n_links, r.class_id) for r in jaccard.joined(df).collect())))
    assert len(seen) == 1 and seen <= {tuple(sorted([(1, 1, 1), (1, 1, 1), (a, 1, 1), (b, 0, b), (4, 0, 4)])) for a, b in ((2, 3), (3, 2))}


def test_jaccard_of_a_large_group(spark):
    """Near copies that meet in most buckets, in many blocks: every link is found once."""
    rng = random.Random(3)
    base = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"c{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 7):
        got = {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in jaccard.joined(df, jaccard.Settings(block=block)).collect()}
        assert got == plain_jaccard(rows)


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.id: r.component_id for r in graphs.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# --- op5 ---


def plain_base(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))


def check_quality(df, refs):
    got = quality.measured(df, refs).collect()
    wanted = defaultdict(set)
    for r in df.collect():
        wanted[r.doc_id].add(plain_base(r.text))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in wanted[r.doc_id]
        assert not (r.base_failed and r.kept)
    return got


def test_quality_base_and_odd(docs, odd_docs, no_docs):
    refs = quality.references(docs)
    check_quality(docs, refs)
    assert len(check_quality(odd_docs, refs)) == odd_docs.count()
    assert quality.kept(odd_docs, refs).columns == odd_docs.columns
    empty = quality.references(no_docs)
    assert quality.measured(no_docs, empty).count() == 0 and quality.kept(docs, empty).count() > 0


def test_quality_tells_junk_from_clean(spark, docs):
    refs = quality.references(docs)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.measured(docs, refs).join(labels, "doc_id").filter("not base_failed and n_words >= 100").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) >= 0.97 * len(clean)


def plain_verdict(docs, rules):
    """kept of each row by the rules as they are stated: histograms in dictionaries, divergence by its formula."""
    kind = lambda c: c if c in "#*$%&|<>" else "letter" if c.isascii() and c.isalpha() else "digit" if c in "0123456789" else "line" if c == "\n" else "blank" if c in " \t\x0b\x0c\r" else c if c in ".," else "mark" if c in ";:!?'\"()-" else "other" if c.isascii() else "wide"
    words_of = lambda t: re.findall("[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    letters_of = lambda t: [c for b in t.encode() for c in [chr(b).lower() if b < 128 else b] if b > 127 or c in "abcdefghijklmnopqrstuvwxyz"]
    chars, words, letters = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        if r.lang:
            chars[r.lang].update(map(kind, r.text or ""))
            letters[r.lang].update(letters_of(r.text or ""))
            words[r.lang].update(words_of(r.text or ""))
    have = [k for k in chars if sum(words[k].values()) >= rules.reference_words]
    tie = lambda w: int(quality._letter_words(*wd.text_bytes(pa.array([w])))[0][0])
    tops = {k: {w for w, _ in sorted(words[k].items(), key=lambda x: (-x[1], tie(x[0])))[: rules.common_words]} for k in have}
    common = set().union(*tops.values())
    refs = {}
    for k in have:
        top = tops[k]
        hist = {w: words[k][w] for w in top}
        hist[None] = sum(words[k].values()) - sum(hist.values())
        refs[k] = (chars[k], hist)

    def divergence(p, q):
        sp, sq, total = sum(p.values()), sum(q.values()), 0.0
        if not sp:
            return 1.0
        for x in {*p, *q}:
            a, b = p.get(x, 0) / sp, q.get(x, 0) / sq
            total += sum(v / 2 * math.log2(2 * v / (a + b)) for v in (a, b) if v)
        return math.sqrt(max(total, 0))

    out = []
    for r in docs:
        text = r.text or ""
        base = plain_base(text)[-1]
        c, w = Counter(map(kind, text)), Counter(x if x in common else None for x in words_of(text))
        n_c, n_w = sum(c.values()), sum(w.values())
        own = Counter(letters_of(text))
        spelt = [k for k in refs if divergence(own, letters[k]) <= rules.letter_distance + rules.slack * math.sqrt(quality.N_LETTERS / 4 / max(own.total(), 1))]
        near = [min((divergence(c, ref[0]) for ref in refs.values()), default=0), min((divergence(w, refs[k][1]) for k in spelt), default=0)]
        odd = n_c >= rules.class_min_chars and near[0] > rules.class_distance + rules.slack * math.sqrt(quality.N_CLASSES / 2 / n_c)
        odd = odd or n_w >= rules.word_min_words and near[1] > rules.word_distance + rules.slack * math.sqrt(rules.common_words / 4 / n_w)
        out.append((r.doc_id, not base and not odd, near))
    return out


def test_verdict_equals_plain(docs, odd_docs):
    for df in (docs, odd_docs):
        rows, refs = df.select("doc_id", "text", "lang").collect(), quality.references(df)
        wanted = defaultdict(list)
        for i, keep, near in plain_verdict(rows, quality.Rules()):
            wanted[i].append((keep, near))
        for r in quality.measured(df, refs).collect():
            assert any(r.kept == k and r.char_distance == pytest.approx(d[0], abs=1e-6) and r.word_distance == pytest.approx(d[1], abs=1e-6) for k, d in wanted[r.doc_id]), r


def test_a_verdict_does_not_depend_on_tag_or_corpus(spark):
    """One clean text, with each tag and beside few or many texts of its language; a list of words is rejected in all."""
    rng = random.Random(5)
    made = lambda: "".join(rng.choice("lo ra mi ten dor sal ver pon ket nis ga bri the and of".split()) for _ in range(3))
    rows = [(i, ". ".join(f"the {made()} of {made()} and {made()} in the {made()}" for _ in range(12)), "en") for i in range(60)]
    german = "Der Hund lief über die Straße und bellte laut den Nachbarn an weil dieser gerade sein Haus neu strich und dabei pfiff während oben zwei Katzen auf dem warmen Dach lagen ohne sich zu rühren obwohl unten viele Kinder mit großem Lärm spielten riefen lachten und sangen bis endlich am späten Abend alle müde nach Hause gingen wo schon das Essen auf den Tischen stand"
    more = [(100 + i, f"Es war {i} Mal. " + german.replace("Hund", f"Hund{chr(97 + i % 26)}"), "de") for i in range(30)]
    listed = " ".join(made() for _ in range(90))
    for beside in ([], more[:2], more):
        own = [(900, german, "de"), (901, german, None), (902, german, "en"), (903, listed, "en"), (904, listed, None), (905, listed, "de")]
        df = spark.createDataFrame([*rows, *beside, *own], "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in quality.measured(df, quality.references(df)).collect()}
        assert got[900].kept and got[901].kept and got[902].kept and not got[903].base_failed
        assert not got[903].kept and not got[904].kept and not got[905].kept
        assert {r.doc_id for r in quality.kept(df, quality.references(df)).collect()} == {i for i, r in got.items() if r.kept}


# --- op6 ---


@pytest.mark.parametrize("settings", [embeddings.Settings(per_pivot=20, block=16), embeddings.Settings(per_pivot=4, fan=3, block=5), embeddings.Settings()])
def test_embeddings_equal_plain(spark, settings):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 8)) * 0.1, base[:5]])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0, 2.0]), (904, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min(label[i], *(label[near[i]] if near[i].any() else [label[i]])) for i in range(len(x))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, settings).collect()}
    assert got == {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 905)}


def plain_links(rows, cosine=0.95):
    """Brute force over rows (id, vector); rows of equal position in the result."""
    unit = [None if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    n, near = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = unit[i], unit[j]
            if i != j and a is not None and b is not None and rows[i][0] is not None and rows[j][0] is not None and len(a) == len(b) and a @ b >= cosine:
                near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None, bool(ids) and min(ids) == rows[i][0] or rows[i][0] is None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_embeddings_of_several_lengths_and_repeated_ids(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0, 0.01]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 2.0]), (5, [0.0, 1.0, 0.0]), (5, [1.0, 0.0, 0.02]), (5, [3.0, 0.0, 0.06]), (6, []), (None, [1.0, 0.0, 0.0]), (7, None), (8, [math.inf, 1.0])]
    rows += [(int(10 + i % 30), [float(x) for x in rng.normal(size=2 + i % 3)]) for i in range(60)]
    if kind == "string":
        rows = [(None if i is None else f"v{i:03d}", v) for i, v in rows]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id {kind}, embedding array<double>, key string")
    for settings in (embeddings.Settings(), embeddings.Settings(per_pivot=3, fan=2, block=4)):
        got = sorted((tuple(r) for r in embeddings.near_duplicates(df, settings).collect()), key=repr)
        assert got == plain_links(rows)


def test_embeddings_of_extreme_lengths_link(spark):
    """Vectors whose squares over- or underflow are finite: they link by their direction."""
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [1.0, 0.0]), (6, [5e-324, 5e-324]), (7, [1.7e308, 1e300]), (8, [0.0, -1e-320])]
    rows += [(100 + i, [math.cos(i) * 10.0 ** (i * 13 - 300), math.sin(i) * 10.0 ** (i * 13 - 300)]) for i in range(45)]
    scaled = [(i, [x / max(map(abs, v)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for settings in (embeddings.Settings(), embeddings.Settings(per_pivot=3, fan=2, block=4)):
        got = sorted((tuple(r) for r in embeddings.near_duplicates(df, settings).collect()), key=repr)
        assert got == plain_links(scaled) and dict((g[0], g[1]) for g in got)[1] >= 2


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0


# --- op7 ---


def test_counts_equal_the_tokenizer(docs):
    pieces = queries.unigram_pieces()
    least = min(s for _, s in pieces)
    model = Tokenizer(models.Unigram([("<unk>", least)] + [(f"<0x{i:02X}>", least) for i in range(256)] + pieces, 0, True))
    counter = unigram.Counter(tuple(pieces))
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "  a  b ", "漢字 😀\n x\t", "ﷺ" * 40]
    for text in texts:
        assert counter.count(text)[0] == (len(model.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


def test_counts_with_ties():
    counter = unigram.Counter((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("bc", -2.0), ("c", -1.0)))
    assert counter.count("abc") == (3, -4.0)  # the earliest start wins a tie: ▁ + ab + c


def test_counts_on_odd_and_empty(odd_docs, no_docs):
    rows = unigram.token_counts(odd_docs, queries.unigram_pieces()).collect()
    assert len(rows) == odd_docs.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (4, 5))
    assert unigram.token_counts(no_docs, queries.unigram_pieces()).count() == 0


# --- op8 ---


def check_pieces(rows, ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(by_doc) == set(ids) and sum(len(x) for x in ids.values()) > 2048 * (len(by_seq) - 1)


def hf_ids(df):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.collect()}


def test_packing_is_exact(spark, docs):
    rows = queries.op8_packing(spark, "/root/testdata/sf0.001").collect()
    check_pieces(rows, hf_ids(docs))


def test_packing_on_odd_and_empty(odd_docs, no_docs):
    unique = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(queries.packed_documents(unique).collect(), hf_ids(unique))
    assert queries.packed_documents(odd_docs).select("doc_tokens").count() >= odd_docs.count()
    assert queries.packed_documents(no_docs).count() == 0


def test_special_string_is_one_token(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    check_pieces(queries.packed_documents(df).collect(), hf_ids(df))


def test_windows_hold_the_mixture():
    schedule = packing.Schedule([5000, 3000, 200], [1, 3, 0], 400)
    given = [0, 0, 0]
    for w in range(1, 30):
        now = schedule.given(w)
        if now[0] < 5000 and now[1] < 3000 and w < 10:
            assert abs(now[0] - 100 * w) <= 1 and abs(now[1] - 300 * w) <= 1
        assert all(a <= b for a, b in zip(given, now))
        given = now
    places = sorted((place + i) for q, n in enumerate((5000, 3000, 200)) for _, size, place in schedule.spans(q, 0, n) for i in range(size))
    assert places == list(range(8200))


def plain_round_robin(totals, weights, window):
    """Deficit round-robin played window by window: tokens that each queue has given by the end of each window."""
    given, credit, out = [0] * len(totals), [Fraction(0)] * len(totals), []
    while any(g < t for g, t in zip(given, totals)):
        live = [w if g < t else 0 for w, g, t in zip(weights, given, totals)]
        if not sum(live):
            live = [int(g < t) for g, t in zip(given, totals)]
        if out and live != last:  # noqa: F821
            credit = [Fraction(0)] * len(totals)
        last = live  # noqa: F841
        for q, w in enumerate(live):
            credit[q] += Fraction(w * window, sum(live))
            take = min(int(credit[q]), totals[q] - given[q])
            credit[q] -= take
            given[q] += take
        out.append(list(given))
    return out


@pytest.mark.parametrize("weights", [[1, 3, 7], [5, 1, 0], [2, 2, 2]])
def test_windows_equal_the_plain_round_robin(weights):
    totals, window = [5000, 3000, 777], 400
    schedule = packing.Schedule(totals, weights, window)
    for w, given in enumerate(plain_round_robin(totals, weights, window), 1):
        assert schedule.given(w) == given


def test_many_sources_with_weights(spark):
    """More sources than queues: all levels keep every token, and each window holds the weighted sources' shares."""
    rows = [(i, f"{i} " * (20 + i % 7), "en", f"s{i % 90}", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    byte_ids = lambda: lambda text: np.frombuffer(text.encode() + b"\1", np.uint8).astype(np.uint32)
    tokens = packing.tokenised(df, byte_ids)
    ids = {r[0]: byte_ids()(r[1]) for r in rows}
    source = {r[0]: r[3] for r in rows}
    for weights, temper in ((None, None), (None, 0.5), ({f"s{i}": 1 + i for i in range(80)}, None)):
        got = packing.packed(tokens, weights, window_sequences=4, temper=temper, top=5, in_group=4).collect()
        check_pieces(got, ids)
        window = 4 * 2048
        share = Counter()
        for r in got:
            if (r.sequence_id * 2048) // window == 0:
                share[source[r.doc_id]] += r.length
        if weights:  # the top queues are those of the largest of the weighted sources
            totals = Counter()
            for i, x in ids.items():
                totals[source[i]] += len(x)
            first = sorted(weights, key=lambda k: (-totals[k], k))[:5]
            for k in first:
                assert abs(share[k] - min(totals[k], window * weights[k] / sum(weights.values()))) <= 1 + 5  # a window may end a token a queue early


def test_windows_of_the_query_hold_its_mixture(spark, docs):
    rows = queries.op8_packing(spark, "/root/testdata/sf0.001").collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    totals, places = Counter(), defaultdict(list)
    for r in rows:
        totals[source[r.doc_id]] += r.length
        places[source[r.doc_id]].append((r.sequence_id * 2048 + r.offset, r.length))
    names = sorted(totals, key=lambda k: (-totals[k], k))
    weights = [max(1, round(1000 * totals[k] ** queries.MIXTURE_POWER)) for k in names]
    assert len(set(weights)) > 1
    for w, given in enumerate(plain_round_robin([totals[k] for k in names], weights, 2048 * 64), 1):
        end = sum(given)
        for k, g in zip(names, given):
            assert sum(min(n, max(0, end - at)) for at, n in places[k]) == g


# --- op9 ---


class PlainPage(HTMLParser):
    """Text, title, language and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.links, self.title, self.lang, self.hidden, self.in_title = [], [], None, None, 0, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag in warc.HIDDEN:
            self.out.append(" ")
            self.hidden += 1
        if tag in warc.BLOCKS:
            self.out.append("\n")
        self.in_title = tag == "title" and self.title is None
        if self.in_title:
            self.title = ""
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")
        if tag == "a" and (href := " ".join((attrs.get("href") or "").split())) and href not in self.links:
            self.links.append(href)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in warc.HIDDEN:
            self.hidden -= 1
        elif tag in warc.BLOCKS:
            self.out.append("\n")
        self.in_title = False

    def handle_comment(self, data):
        self.out.append(" ")

    def text_of(self, raw):
        if not self.hidden:
            self.out.append(raw)
            if self.in_title:
                self.title += raw

    def handle_data(self, data):
        self.text_of(data)

    def handle_entityref(self, name):
        self.text_of(f"&{name};")

    def handle_charref(self, name):
        self.text_of(f"&#{name};")


def plain_page(page):
    p = PlainPage()
    p.feed(page)
    p.close()
    text = re.sub(r"\s*\n\s*", "\n", re.sub("[ \t\r\f\v\xa0]+", " ", html.unescape("".join(p.out)))).strip()
    return text, p.title and " ".join(html.unescape(p.title).split()), p.lang, p.links


def sha1_32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_equals_the_library_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = defaultdict(dict)
    for r in queries.op9_warc(spark, "/root/testdata/sf0.001").collect():
        rows[r.page_id][r.record_type] = r
    assert len(rows) == pages.count()
    sources = {r.page_id: r for r in warc.responses(pages).collect()}
    assert len({r.record_id for r in sources.values()}) == len(sources)
    for p in pages.collect():
        text, title, lang, links = plain_page(p.html)
        one, two, source, body = rows[p.page_id]["metadata"], rows[p.page_id]["conversion"], sources[p.page_id], p.html.encode()
        assert bytes(source.body) == body and source.payload_digest == sha1_32(body) and source.target_uri == p.url
        assert two.block == text
        fields = [x.split(": ", 1) for x in one.block.split("\r\n")[:-1]]
        assert [v for k, v in fields if k == "title"] == ([title] if title is not None else [])
        assert [v for k, v in fields if k == "language"] == ([lang] if lang else [])
        assert [v for k, v in fields if k == "outlink"] == links
        assert ["http-Content-Length", str(len(body))] in fields
        for r in (one, two):
            assert r.refers_to == source.record_id and r.source_payload_digest == sha1_32(body) and r.refers_to_target_uri == p.url
            assert r.block_digest == sha1_32(r.block.encode()) and r.content_length == len(r.block.encode())
            head, _, block = bytes(r.record).partition(b"\r\n\r\n")
            assert block == r.block.encode() + b"\r\n\r\n" and f"WARC-Refers-To: {r.refers_to}".encode() in head


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_keep_the_sources_own_ids_and_digests(spark, tmp_path, packed):
    pages = [{"record_id": f"<urn:uuid:{i}>", "target_uri": f"http://a/{i}" if i else None, "date": f"2026-01-0{i + 1}T00:00:00Z", "http_header": f"HTTP/1.1 200 OK\r\nX-Own: {i}\r\n\r\n".encode(), "body": f"<title>t{i}</title><p>WARC/1.1 body {i}</p>".encode(), "payload_digest": f"sha1:OWN{i}"} for i in range(5)]
    data = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"".join(map(warc.response_bytes, pages))
    (tmp_path / "a.warc").write_bytes(gzip.compress(data) if packed else data)
    source = warc.read_responses(spark, str(tmp_path))
    assert [(r.record_id, r.target_uri, bytes(r.body)) for r in source.orderBy("page_id").collect()] == [(p["record_id"], p["target_uri"], p["body"]) for p in pages]
    for r in warc.derivatives(source).collect():
        p = pages[r.page_id]
        assert (r.refers_to, r.refers_to_date, r.source_payload_digest, r.refers_to_target_uri) == (p["record_id"], p["date"], p["payload_digest"], p["target_uri"])
        assert r.record_type == "conversion" or f"http-X-Own: {r.page_id}\r\ntitle: t{r.page_id}\r\n" in r.block
    assert list(warc.parse(data[:-30])) == list(warc.parse(data))[:-1]


def _warc_record(i, length=None, body=None):
    body = body or b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i
    size = b"" if length == "none" else b"Content-Length: %s\r\n" % (str(len(body) if length is None else length).encode())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\n" % i + size + b"\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [1 << 23, 7, 64])
def test_warc_goes_on_after_bad_records(piece, monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", piece)
    ids = lambda data: ([r["record_id"] for r in warc.parse(data, tally)], tally["skipped"])
    good = [_warc_record(i) for i in range(6)]
    for bad in ("none", "x7", 3, 10**6, 10**40, 40):
        tally = Counter()
        assert ids(b"".join([good[0], _warc_record(9, bad), *good[1:3], _warc_record(8, bad), good[3]])) == (["<r0>", "<r1>", "<r2>", "<r3>"], 2), bad
    tally = Counter()
    assert ids(b"junk\r\n" + good[0] + b"WARC/1.1\r\nno end of header") == (["<r0>"], 1)
    tally = Counter()
    inside = _warc_record(7, body=b"HTTP/1.1 200 OK\r\n\r\nx\r\n\r\nWARC/1.1 is a format\r\n\r\n")
    assert ids(inside + good[1] + _warc_record(5, body=b"z" * 1000)[:-400]) == (["<r7>", "<r1>"], 1)
    tally = Counter()
    members = [gzip.compress(g) for g in good]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    assert ids(b"".join([*members[:2], bytes(broken), *members[3:]]))[0] == ["<r0>", "<r1>", "<r3>", "<r4>", "<r5>"] and tally["skipped"] >= 1
    tally = Counter()
    assert ids(gzip.compress(b"".join(good))) == ([f"<r{i}>" for i in range(6)], 0) and ids(b"") == ([], 0)
    assert ids(members[0] + members[1][:-9])[0] in (["<r0>"], ["<r0>", "<r1>"]) and tally["skipped"] >= 1


def test_warc_report_counts_what_was_skipped(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_warc_record(1, "none") + _warc_record(2) + _warc_record(3))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_warc_record(4)))
    got = {r.path.rsplit("/", 1)[1]: (r.n_records, r.n_skipped) for r in warc.reading_report(spark, str(tmp_path)).collect()}
    assert got == {"a.warc": (2, 1), "b.warc.gz": (1, 0)} and warc.read_responses(spark, str(tmp_path)).count() == 3


def test_warc_text_and_odd(spark):
    assert warc.plain_text("<p>a<b>b</b> &amp; c</p><script>var x='</p>'</script><!-- no -->d") == "ab & c\nd"
    assert warc.plain_text("<" * 5000) == "<" * 5000
    assert warc.read_page("<a title='x>y' href=\"u>v\">t</a> 1 < 2 <b")[0::3] == ("t 1 < 2 <b", ["u>v"])
    df = spark.createDataFrame([(1, None, None, "c"), (None, "u", "", "c"), (2, "u", "x" * 100_000, "c"), (2, "u", "x" * 100_000, "c")], "page_id long, url string, html string, record_id string")
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6 and warc.derivatives(warc.responses(df.limit(0))).count() == 0


@pytest.mark.parametrize("piece", ["<a href", "<a href='", "<title>", "<html lang=", "<!--", "<script>", "<p", "<a x=\"'>", "</script", "= ", "<a href=\"x\" ", "&#"])
def test_hostile_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    warc.read_page(page)
    assert time.process_time() - start < 5


# --- op10 ---


def test_toxicity_held_out_accuracy(spark):
    """Over the whole table at two sizes; a fit that has collapsed predicts nothing and fails here."""
    for size, least in (("sf0.1", 0.9), ("sf0.01", 0.6)):
        d = f"/root/testdata/{size}"
        labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").toxic
        got = queries.op10_toxicity(spark, d).filter("held_out").toPandas().set_index("doc_id").join(labels, how="inner")
        clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
        assert (clean.predicted == 0).mean() > 0.997 and (toxic.predicted == 1).mean() >= least, size


def test_toxicity_marks_change_the_kind():
    lexicon = {"idiot": (50, 50)}
    grammar = toxicity.Grammar(lexicon, 0.1, toxicity.Settings())
    kind = lambda text: toxicity.KINDS[int(grammar.sums(text)[0].argmax())]
    assert kind("an idiot there") == "insult" and kind("you are an idiot") == "insult at a target"
    assert kind("this is not an idiot") == "insult negated" and kind("people said idiot") == "insult reported"
    assert not grammar.sums("nothing here")[0].any() and grammar.sums("idiot", 1)[0][0] < grammar.sums("idiot")[0][0]


def plain_sums(grammar, text):
    """The grammar by looking around each match: no automata, no memo."""
    s, out = grammar.settings, [0.0] * len(toxicity.KINDS)
    for clause in re.split(r"[.!?;|\n]", text.lower()):
        tokens = re.findall(r"[^\W\d_]+|[\"“”«»]", clause)
        for i, t in enumerate(tokens):
            entries = [grammar.lexicon[f] for f in [t, *(t[:k] + "*" for k in s.prefixes if len(t) > k)] if f in grammar.lexicon]
            target = any(x in toxicity.TARGETS for x in tokens[max(0, i - 4) : i]) or any(x in toxicity.TARGETS for x in tokens[i + 1 : i + 4])
            if entries:
                odds = []
                for pos, n in entries:
                    p = (pos + s.shrink * grammar.rate) / (n + s.shrink)
                    odds.append((math.log(p / (1 - p)) if 0.5 < p < 1 else 0.0, (pos, n)))
                kind, weight = 0, max(odds)[0]
            elif t in toxicity.THREATS:
                intent = any(x in toxicity.INTENTS for x in tokens[max(0, i - 4) : i])
                kind, weight = 4, 3.0 if intent and target else 1.5 if intent or target else 0.5
            else:
                continue
            reported = any(x in toxicity.REPORTS for x in tokens[:i]) or sum(x in "\"“”«»" for x in tokens[:i]) % 2
            negated = any(x in toxicity.NEGATIONS for x in tokens[max(0, i - 3) : i])
            out[kind + (3 if reported else 2 if negated else 1 if target else 0)] += weight
    return out


def test_toxicity_equals_plain():
    rng = random.Random(11)
    lexicon = {"idiot": (50, 52), "stup*": (8, 9), "awfu*": (5, 7), "awfulness": (9, 9), "dull": (2, 4)}
    grammar = toxicity.Grammar(lexicon, 0.1, toxicity.Settings())
    words = ["idiot", "stupidity", "awful", "awfulness", "dull", *toxicity.TARGETS[:4], *toxicity.NEGATIONS[:3], *toxicity.REPORTS[:3], *toxicity.THREATS[:4], *toxicity.INTENTS[:4], "the", "house", "was", '"', ".", "!", "\n", "7", "Idiot"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        sums, n = grammar.sums(text)
        assert sums == pytest.approx(plain_sums(grammar, text)) and n == len(re.findall("[A-Za-z]+", text))


def test_toxicity_fit_equals_plain(spark, docs):
    """Lexicon, left-out labels and regression by dictionaries and small gradient steps."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, s = toxicity.fit(docs, labels), toxicity.Settings()
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    rows = [(r.text or "", known[r.doc_id]) for r in docs.collect() if r.doc_id in known]
    pos, n = Counter(), Counter()
    for text, toxic in rows:
        found = {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in [w, *(w[:k] + "*" for k in s.prefixes if len(w) > k)]}
        n.update(found)
        pos.update(found if toxic else [])
    assert model.grammar.lexicon == {f: (pos[f], n[f]) for f in n if pos[f] >= s.min_toxic and 2 * pos[f] > n[f]}
    x = np.array([[1.0, *model.grammar.vector(text, toxic)] for text, toxic in rows])
    y, w = np.array([t for _, t in rows], float), toxicity.PRIOR.copy()
    for _ in range(200_000):
        slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - s.ridge * (w - toxicity.PRIOR)
        w += 0.0005 * slope
        if np.abs(slope).max() < 1e-9:
            break
    w[1:-1], w[-1] = np.maximum(w[1:-1], 0), min(w[-1], 0)
    assert model.weights == pytest.approx(w, abs=1e-4)


def test_patterns_decide():
    """Without any lexicon: intent, verb and target together are a threat, the verb alone is not; negation and reports
    take it back. With one entry, marks move the score."""
    bare = toxicity.Model(toxicity.Grammar({}, 0.1, toxicity.Settings()), toxicity.PRIOR)
    assert bare.score("I will kill you") >= 0.7 and bare.score("we will burn your house") >= 0.7
    for text in ("a fire can burn wood", "we will burn wood", "I will not kill you", "he said I will kill you", "", "you and me"):
        assert bare.score(text) < 0.7, text
    known = toxicity.Model(toxicity.Grammar({"idiot": (6, 8)}, 0.1, toxicity.Settings()), toxicity.PRIOR)
    plain, aimed, negated, reported = (known.score(t) for t in ("the idiot on the hill", "you idiot on the hill", "not an idiot on hills", "they said idiot on hills"))
    assert aimed > plain > negated and plain > reported
    assert known.score("idiot, idiot and idiot") > known.score("idiot and more words")


def test_toxicity_on_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    assert toxicity.scored(odd_docs, model).count() == odd_docs.count()
    assert toxicity.clean(odd_docs, model).columns == odd_docs.columns
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.scored(no_docs, empty).count() == 0 and toxicity.scored(odd_docs, empty).filter("predicted = 1").count() == 0


# --- shared helpers, pipeline ---


def test_words_and_hashes():
    texts = ["a b", None, "", " x\n\ny ", "é 漢字 z"]
    data, at = wd.text_bytes(pa.array(texts))
    seg = wd.segments(data, at, wd.is_space())
    assert [bytes(data[a:b]).decode() for a, b in zip(seg.start, seg.end)] == [w for t in texts for w in split(t)]
    h = wd.span_hashes(data, seg.start, seg.end, wd.byte_codes())
    again, at2 = wd.text_bytes(pa.array(["zz b x"]))
    s2 = wd.segments(again, at2, wd.is_space())
    h2 = wd.span_hashes(again, s2.start, s2.end, wd.byte_codes())
    assert h2[1] == h[1] and h2[2] == h[2] and len(set(h)) == len(h)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows
        rows = stage(spark, before, "/root/testdata/sf0.001")
        assert rows.columns == columns and 0 < rows.count() <= before.count(), name
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001").collect(), hf_ids(rows))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_on_odd_and_empty(spark, odd_docs, no_docs, tmp_path):
    """Nulls in every column, very long and empty texts, repeated rows and ids, clashing columns; and tables without rows."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs, known in (("odd", odd_docs, labels), ("none", no_docs, labels), ("bare", odd_docs, labels.limit(0))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        known.write.parquet(f"{at}/labels.parquet")
        rows = spark.read.parquet(f"{at}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            before = rows.count()
            rows = corpus_pipeline.written(function(spark, rows, at), "odd")
            assert rows.columns == docs.columns and rows.count() <= before, (name, stage)
        pieces = corpus_pipeline.run(spark, at).collect()
        assert len(pieces) == 0 if name == "none" else {p.doc_id for p in pieces} == {r.doc_id for r in rows.collect()}
        kept = [r.doc_id for r in rows.collect()]
        assert all(i not in kept for i in (4, 5, 6, 7, 8)) and kept.count(1) <= 1
