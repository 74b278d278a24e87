"""The ten operators against brute force on small fixtures, with the odd cases that each docstring defines."""

import base64
import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracelight.llm import bag_minhash, char_crf, kit, licenses, line_dedup, pii, pivot_topk, poisson_mix, pstable, resample, sparse_suffix, tree_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with working columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for c in ("node", "class", "draw_", "_host", "rate", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    base = [prose(r, n) for n in (0, 1, 3, 5, 60, 120, 300, 5000)]
    passage = prose(r, 70)
    rows = list(enumerate(base))
    rows += [(20, base[5]), (21, base[5]), (21, base[5]), (22, None), (23, ""), (None, base[6]), (24, base[7] + " tail")]
    for i in range(12):  # a family of near copies
        w = base[6].split()
        for _ in range(i * 3):
            w[r.randrange(len(w))] = "zz" + str(r.random())[2:6]
        rows.append((100 + i, " ".join(w)))
    rows += [(200, prose(r, 40) + " " + passage + " " + prose(r, 30)), (201, prose(r, 11) + " " + passage), (202, passage.upper() + "! " + prose(r, 90)), (203, " ".join(["same"] * 400))]
    return rows


# --- 1 ---


def brute_links(rows, bound=0.98):
    """(vec_id, n_links, component_id) of each row."""
    ok = [n for n, (i, v, l) in enumerate(rows) if l is not None and i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = collections.Counter(), {n: n for n in range(len(rows))}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for at, a in enumerate(ok):
        for b in ok[at + 1 :]:
            v, w = (np.array(rows[n][1], float) for n in (a, b))
            if rows[a][2] == rows[b][2] and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= bound:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for n, (i, *_) in enumerate(rows):
        low[top(n)] = i if top(n) not in low or i is None else min(low[top(n)], i)
    return sorted((str(i), links[n], low[top(n)]) for n, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(pstable, "BIN", 200)
    monkeypatch.setattr(kit, "HOT", 16)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        center = rng.standard_normal(16)
        for _ in range(8):
            rows.append((len(rows), (center + rng.standard_normal(16) * rng.choice([0.02, 0.2])).tolist(), c % 2))
    center = rng.standard_normal(16)
    rows += [(100 + i, (center + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(100)]  # one group with half of all rows
    rows += [(900 + i, rows[3][1], rows[3][2]) for i in range(40)]
    rows += [(950, None, 1), (951, [0.0] * 16, 1), (952, [float("nan")] * 16, 1), (953, rows[0][1], None), (954, [1.0, None], 1), (955, [], 1), (956, [1.0, 1.0], 0), (957, [2.0, 2.0], 0)]
    rows += [(958, rows[20][1], rows[20][2]), (958, rows[40][1], rows[40][2]), (958, rows[40][1], rows[40][2]), (None, rows[20][1], rows[20][2]), (None, None, None), (960, [-0.0, 1.0], 0), (961, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("bucket", F.lit(1))
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in pstable.linked_vectors(df, block=block).collect())
    assert got == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in pstable.linked_vectors(df.where("vec_id > 940 or vec_id is null")).collect())
    assert pstable.linked_vectors(df.limit(0)).count() == 0


# --- 2 ---


def brute_spans(t):
    out = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)], [], [], []]
    out[1] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out[2].append(m.span())
    out[3] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("ab.@-+% 0123456789()é\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(t)[0] == brute_spans(t), t


def test_tagger_learns_and_reconciles(spark):
    background = [prose(random.Random(i), 80) for i in range(8)]
    tagger = char_crf.trained(tuple(background), 900, 96, 12, 6)
    x, y = char_crf.labelled_windows(background, 200, 96, seed=99)
    p = tagger.decode(x)
    kind = lambda a: (a + 1) // 2
    assert (kind(p) == kind(y)).mean() > 0.93  # held out
    held = (kind(y) > 0).mean()
    assert (kind(p) == kind(y)).mean() > 1 - held + 0.5 * held
    text = "a b mail x.50@mail3.example.com and +1 (743) 555-3824 é 152.143.123.131 4785380592391139 " * 400
    rows = [(1, text), (2, None), (3, ""), (None, "x.1@a.bc"), (4, "x.1@a.bc"), (4, "x.1@a.bc")]
    got = pii.personal_data(docs(spark, rows), tagger).collect()
    assert len(got) == 6
    for r in got:
        t = next(b or "" for a, b in rows if a == r.doc_id)
        base = brute_spans(t)
        line = ",".join(f"{char_crf.KINDS[k]}:{a}:{b}" for k in range(4) for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, base))
        assert set(line.split(",")) <= set(r.spans.split(","))


def test_decoding_is_the_best_path():
    """Viterbi against all paths of short windows, with the hidden states that training uses."""
    rng = np.random.default_rng(4)
    t = char_crf.Tagger(5, seed=8)
    t.p["move"] = rng.standard_normal(t.p["move"].shape).astype(np.float32)
    x = rng.integers(0, char_crf.CLASSES, (6, 4)).astype(np.uint8)
    both = np.concatenate([t._direction(x, d)[0] for d in "fb"], axis=2)
    e = both @ t.p["out"] + t.p["bias"]
    assert np.allclose(e, t.emissions(x), atol=1e-5)
    move, first = t.p["move"] + char_crf.BARRED, char_crf.BARRED[0]
    for row, path in enumerate(t.decode(x)):
        score = lambda p: first[p[0]] + sum(e[i, row, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
        assert tuple(path) == max(itertools.product(range(char_crf.TAGS), repeat=4), key=score)


def test_tagger_on_held_out_documents(spark):
    """Loose forms set into documents that gave no background: at least nine in ten are found; unchanged documents stay clean."""
    rows = kit.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").select("text").collect()
    texts = [r[0] or "" for r in rows]
    r = random.Random(3)
    r.shuffle(texts)
    tagger = char_crf.trained(tuple(sorted(re.sub(r"[0-9@+]+", "", t[len(t) // 3 :][:2000]) for t in texts[:64])), pii.WINDOWS, pii.TRAINED, pii.HIDDEN, pii.EPOCHS)
    held = [t for t in texts[64:] if len(t) > 60][:300]
    assert sum(bool(more) for _, more in pii.found(held, tagger)) <= 3
    hits = 0
    for t in held:
        kind = r.randrange(4)
        span = char_crf.example(r, char_crf.KINDS[kind])
        while (0, len(span)) in pii.base_spans(span)[0][kind]:
            span = char_crf.example(r, char_crf.KINDS[kind])
        at = t.find(" ", r.randrange(len(t))) if " " in t else len(t)
        at = at if at >= 0 else len(t)
        (_, more), = pii.found([f"{t[:at]} {span} {t[at:]}"], tagger)
        hits += (kind, at + 1, at + 1 + len(span)) in more
    assert hits >= 0.9 * len(held)


def test_spans_across_windows():
    class Marks:
        def decode(self, block):
            at, z, gap = (block == char_crf.codes(c)[0] for c in "@z ")
            near = np.roll(at, 1, axis=1) | np.roll(at, -1, axis=1)
            return np.where(at | z | (gap & near), 2, 0).astype(np.int8)

    for before in range(380, 560, 3):
        for local, host in ((40, 5), (5, 40)):
            text = "a" * before + " " + "z" * local + " @ " + "z" * host + " " + "a" * 300
            span = (0, before + 1, before + 4 + local + host)
            assert pii.found([text], Marks())[0][1] == [span]


def test_texts_taken_together():
    """op2: slices hold whole texts, about as many characters as asked, each text once."""
    texts = ["a" * 30, None, "", "b" * 500, "c", "d" * 90, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    got = list(pii.together(batch, 100))
    assert [i for part, _ in got for i in part.column("doc_id").to_pylist()] == list(range(7))
    assert [t for _, some in got for t in some] == [t or "" for t in texts] and [len(some) for _, some in got] == [4, 3]
    assert list(pii.together(batch.slice(0, 0))) == []


def test_gradients():
    t = char_crf.Tagger(3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = char_crf.labelled_windows(["abc def"], 3, 12)
    _, g = t.step(x, y)
    rng = np.random.default_rng(0)
    for k in t.p:
        at = tuple(rng.integers(s) for s in t.p[k].shape)
        old = t.p[k][at]
        t.p[k][at] = old + 1e-3
        up = t.step(x, y)[0]
        t.p[k][at] = old - 1e-3
        down = t.step(x, y)[0]
        t.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * (1 + abs(g[k][at])), k


# --- 3 ---


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(reference, monkeypatch):
    r = random.Random(3)
    c = tree_bpe.Codec(PATH, public_tokenizers.PATTERN)
    monkeypatch.setattr(tree_bpe, "LEAF", 7)
    for i in range(3000):
        alphabet = r.choice(["ab 'ltsvermd", "x  \n\t y1", "é漢字🙂 a", "!?'' s", "0123 .", "the and ing <|endoftext|>"])
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(90)))
        assert c.encode(t) == reference.encode_ordinary(t), repr(t)
    for t in ("a" * 3000, "ab" * 2000 + " " * 900 + "x", "".join(r.choice("etaoinshrdlu") for _ in range(4000)), "é" * 1500, "=-" * 700):
        ids = c.encode(t)
        assert ids == reference.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_rows(spark, reference, corpus):
    got = tree_bpe.encode_documents(docs(spark, corpus), PATH, public_tokenizers.PATTERN, ids=True).collect()
    want = collections.Counter((i, tuple(reference.encode_ordinary(t or ""))) for i, t in corpus)
    assert collections.Counter((r.doc_id, tuple(r.token_ids)) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest() for r in got)


# --- 4 ---


def brute_passages(rows, length=50):
    """Spans of each document: the union of its windows of `length` words that another document holds too."""
    seen, want = collections.defaultdict(set), set()
    rows = [(i, words(t)) for i, t in rows if i is not None]
    for i, w in rows:
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])].add(i)
    for i, w in rows:
        span = None
        for s in range(len(w) - length + 1):
            if len(seen[tuple(w[s : s + length])]) > 1:
                if span and s - span[1] <= length:
                    span[1] = s
                else:
                    want |= {(i, span[0], span[1] + length)} if span else set()
                    span = [s, s]
        want |= {(i, span[0], span[1] + length)} if span else set()
    return want


@pytest.mark.parametrize("seams", [False, True])
def test_passages(spark, corpus, seams):
    r = random.Random(6)
    rows = list(corpus)
    hot = prose(r, 64)  # a passage of a third of all documents, with the same or other words around
    rows += [(300 + i, " ".join([prose(r, r.randrange(40)), *(["a b c d e f g"] * (i % 3 == 0)), hot, *(["h i j k"] * (i % 2)), prose(r, r.randrange(40))])) for i in range(30)]
    family = prose(r, 400).split()
    for i in range(12):  # edits close together: long matches to one side are in other documents than those to the other
        w = list(family)
        for _ in range(10):
            w[r.randrange(len(w))] = prose(r, 1)
        rows.append((400 + i, " ".join(w)))
    settings = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"} if seams else {}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    got = sparse_suffix.repeated_passages(docs(spark, rows)).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert {(x.doc_id, x.start_word, x.end_word) for x in got} == brute_passages(rows) and {200, 201, 202} <= {x.doc_id for x in got} and 203 not in {x.doc_id for x in got}
    assert len(got) == len({tuple(x) for x in got}) and all(x.n_words == x.end_word - x.start_word for x in got)
    assert sparse_suffix.repeated_passages(docs(spark, corpus).limit(0)).count() == 0


def test_passages_of_partitions_in_blocks(spark, corpus):
    """a task holds a block of its partition; keys cut by blocks lose nothing."""
    r = random.Random(8)
    hot = prose(r, 64)
    rows = list(corpus) + [(300 + i, " ".join([prose(r, r.randrange(40)), hot, *(["h i j k"] * (i % 2)), prose(r, r.randrange(40))])) for i in range(40)]
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    got = sparse_suffix.repeated_passages(docs(spark, rows), block=16).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert {(x.doc_id, x.start_word, x.end_word) for x in got} == brute_passages(rows)


def test_neighbours_hold_a_block(block=4096, n=60_000):
    rng = np.random.default_rng(5)
    side, key = rng.integers(0, 9, (50, 100), dtype=np.uint8), np.sort(rng.integers(0, n // 4, n))

    def batches():
        for a in range(0, n, 1000):
            some = [side[i % 50].tobytes() for i in range(a, a + 1000)]
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 1000]), pa.array(some, pa.binary()), pa.array(some, pa.binary()), pa.array(np.arange(a, a + 1000)), pa.array(np.arange(1000, dtype=np.int32))], ["key", "after", "before", "node", "place"])

    tracemalloc.start()
    for _ in sparse_suffix._neighbours(50, 26, block)(batches()):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1000 * n / 2, most  # far below the partition's own 1,000 bytes a suffix and more


def test_minimisers_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 5, 26, 27, 60, 300):
        g = rng.integers(0, 40, n).astype(np.uint64)
        got = set(kit_min := sparse_suffix.minimisers(g, 26).tolist())
        assert kit_min == sorted(got)
        for s in range(n - 25):
            assert any(s <= p < s + 26 and g[p] == g[s : s + 26].min() for p in got)


# --- 5 ---


def test_licenses(spark):
    rows = [(1, "All Rights reserved. x ALL RIGHTS RESERVED"), (2, "under CC-BY 4.0"), (3, "GNU general public license, cc by"), (4, None), (5, ""), (6, "all rights"), (7, "é " * 20000 + "all rights reserved"), (None, "cc by"), (8, "cc by"), (8, "cc by"), (9, "x Permission is hereby granted, free of charge, to a person obtaining a copy of this software y"), (10, "all all rights reserved reserved")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (7, 2, 0, 4, "reserved")
    assert (by[2].n_base, by[2].first_word) == (1, 1) and by[3].base_labels == "cc-by,gpl" and by[3].n_base == 2
    assert (by[4].n_words, by[4].n_base, by[4].first_word, by[4].score) == (0, 0, None, 0.0) and by[5].labels == "" and by[6].n_base == 0
    assert by[7].first_word == 20000 and by[None].n_base == 1 and by[10].n_base == 1 and by[10].first_word == 1
    assert by[9].labels == "mit" and by[9].base_labels == "" and 0 < by[9].score <= 1
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


# --- 6 ---


def test_resampling(spark):
    r = random.Random(8)
    rows = [(i, prose(r, 80) if i % 5 else " ".join(w.upper() + "!!$$" for w in prose(r, 80).split())) for i in range(300)] + [(None, prose(r, 50)), (400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (299, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    out = resample.accepted(df, labels)
    kept = {x.doc_id for x in out.collect()}
    assert out.columns == df.columns
    assert sum(i in kept for i in range(300) if i % 5) >= 235 and not any(i in kept for i in range(0, 300, 5)) and 400 in kept
    assert resample.accepted(df, labels.limit(0)).count() == len(rows)
    assert resample.accepted(df.limit(0), labels).count() == 0


def brute_features(text, buckets):
    """Hashed token 1- and 2-grams by whole numbers: tokens are runs of letters, digits and bytes above 127, or of marks."""
    mask, base, gold = (1 << 64) - 1, kit._BASE, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    hashes = [mix((sum((c + 1) * pow(base, j, 1 << 64) for j, c in enumerate(t)) + len(t) * gold) & mask) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())]
    two = [mix(((gold + a) * gold + b) & mask) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes + two]


def test_resampling_by_brute_force(spark):
    """Weights, Gumbel keys, the fitted level and the draw of every document, from whole numbers and plain sums."""
    r = random.Random(12)
    rows = [(i, prose(r, 30) + (" !! $$ " + prose(r, 5).upper() if i % 4 == 0 else ".")) for i in range(80)]
    rows += [(200, ""), (201, None), (None, prose(r, 9)), (202, "é漢 z" * 40), (203, rows[1][1]), (5, rows[5][1])]
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 80, 2)] + [(9, None, 0), (None, 1, 0), (11, 1, 0), (11, 0, 0)]
    labels, df, buckets = spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), docs(spark, rows), 64
    table, level = resample.fit(df, labels, buckets)
    quality = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            quality[i] = max(q, quality.get(i, 0))
    texts = {}
    for i, t in rows:
        if i in quality:
            texts[i] = min(texts.get(i, t), t)
    held = {x.i for x in spark.createDataFrame([(i,) for i in texts], "i long").where(F.pmod(F.xxhash64(F.lit("held"), "i"), F.lit(3)) == 0).collect()}
    count = lambda some: np.bincount([f for t in some for f in brute_features(t or "", buckets)], minlength=buckets) + 0.5
    target, raw = count(t for i, t in texts.items() if i not in held and quality[i] == 1), count(t for _, t in rows)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(table, want)
    weight = lambda t: sum(want[f] for f in brute_features(t or "", buckets))
    good, bad = ([weight(texts[i]) for i in sorted(held) if (quality[i] == 1) == g] for g in (True, False))
    accuracy = lambda x: sum(w >= x for w in good) / len(good) + sum(w < x for w in bad) / len(bad)
    assert abs(accuracy(level) - max(accuracy(x) for x in good + bad)) < 1e-9
    out = resample.resampled(df, labels, buckets).collect()
    k = sum(weight(t) >= level for _, t in rows)
    keys = {}
    for i, t in rows:
        w = weight(t)
        u = kit.unit(kit.mix(np.array([((i or 0) * 0x9E3779B97F4A7C15 + 5 + int(kit.mix(np.array([round(w * 2**20) if w == int(w) else int(w * 2**20)], np.int64).astype(np.uint64))[0])) & ((1 << 64) - 1)], np.uint64)))[0]
        keys.setdefault((i, t), []).append(w - np.log(-np.log(u)))
    near = collections.Counter((x.doc_id, x.text) for x in out)
    drawn = sorted((v for vs in keys.values() for v in vs), reverse=True)
    bar = drawn[k - 1]
    for (i, t), vs in keys.items():
        if abs(vs[0] - bar) > 1e-3:  # repeated rows draw alike and stay or go together
            assert near[(i, t)] == (len(vs) if vs[0] > bar else 0), i
    for x in out:
        assert abs(x.log_weight - weight(x.text)) < 1e-9 and x.n_features == len(brute_features(x.text or "", buckets))
    with pytest.raises(ValueError):
        resample.score(df.withColumn("draw", F.lit(1)), table)


def test_largest(spark):
    r = random.Random(2)
    v = [r.choice([r.random() * 1e6, r.random(), 5.0, 5.0]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "draw double")
    for k in (1, 7, 1500, 2200, 3000):
        assert resample.largest(df, k) == sorted(v, reverse=True)[k - 1]


# --- 7 ---


@pytest.mark.parametrize("total", [0, 10, 3000, 10**9])
def test_fewest(spark, total):
    """Whatever the bound starts from, the rows of the smallest hashes are returned."""
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    want = [r["id"] for r in rows.orderBy("h", "id").limit(20).collect()]
    assert [r["id"] for r in kit.fewest(rows, total, F.col("h"), 20, "id")] == want
    assert len(kit.fewest(rows.where("id < 7"), total, F.col("h"), 20, "id")) == 7
    assert kit.fewest(rows.where("id < 0"), total, F.col("h"), 20, "id") == []


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 50)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(i, rows_) for i, rows_ in ((400 + j, [1.0] * 8) for j in range(40))]
    rows += [(500, None), (600, [float("inf")] * 8), (700, [None] * 8), (None, [9.0] * 8), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (900, [1.0] * 8)]
    rows += [(400, [1.0] * 8)] * 12 + [(1000, rows[7][1]), (1001, rows[8][1]), (1001, rows[9][1]), (1100, []), (1101, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(0)).withColumn("slot", F.lit(0))
    good = sorted({(i, tuple(int(x) for x in np.floor(1024 * np.array(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    want = set()
    for i, q in good:
        if i % 100 == 0:
            best = sorted({(-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q)})[:10]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(r) for r in pivot_topk.top_k(df, pivots=8).collect()} == want
    assert pivot_topk.top_k(df.limit(0)).count() == 0


def _index(x, pivots):
    """Pivots and cells as the index has them, by plain code."""
    far = pivot_topk._distances(x, pivots)
    near = far.argmin(axis=1)
    r = far[np.arange(len(x)), near]
    cell = near * pivot_topk.ANNULI
    for p in range(len(pivots)):
        mine = np.flatnonzero(near == p)
        cell[mine] += np.searchsorted(np.quantile(r[mine], np.arange(1, pivot_topk.ANNULI) / pivot_topk.ANNULI), r[mine])
    ids = np.unique(cell)
    norm = (x.astype(float) ** 2).sum(axis=1)
    of = [cell == c for c in ids]
    return cell, {"cell": ids, "norm": np.array([norm[m].max() for m in of]), "n": np.array([m.sum() for m in of]), "least": np.array([far[m].min(axis=0) for m in of]), "most": np.array([far[m].max(axis=0) for m in of])}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, p = rng.integers(-900, 900, (400, 6)), rng.integers(-900, 900, (5, 6))
    cell, cells = _index(x, p)
    top, real = pivot_topk.bounds(x[:50], p, cells), pivot_topk.scores(x[:50], x)
    for c, j in enumerate(cells["cell"]):
        assert (real[:, cell == j].max(axis=1) <= top[:, c]).all()


def test_the_index_prunes_where_the_data_allow():
    """Vectors in families: most cells stay unread. Independent directions in 64 dimensions, as in the given tables: all are read."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64))
    family = centres[rng.integers(0, 60, 6000)] + 0.15 * rng.standard_normal((6000, 64))
    alone = rng.standard_normal((6000, 64))
    for rows, least, most in ((family, 0.0, 0.5), (alone, 0.9, 1.0)):
        x = np.floor(1024 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
        pivots = x[rng.choice(len(x), 64, replace=False)]
        share = pivot_topk.visited(x, x[::100], pivots, _index(x, pivots)[1])
        assert least <= share <= most


# --- 8 ---


def test_near_duplicates(spark, corpus):
    rows = [(i, words(t)) for i, t in corpus if i is not None]
    bags = [(i, collections.Counter(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4)))) for i, w in rows if w]
    root = {i: i for i, _ in rows}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a) in enumerate(bags):
        for j, b in bags[x + 1 :]:
            both = (a & b).total()
            if both >= 0.8 * (a.total() + b.total() - both) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    df = docs(spark, corpus)
    got = bag_minhash.near_duplicates(df).collect()
    assert len(got) == len(corpus) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: top(i) for i in root}
    out = bag_minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i in root if top(i) == i)
    assert bag_minhash.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_near_duplicates(spark):
    """Pairs of whole documents at a similarity of 0.8 or more, all of them by brute force: at least nine in ten are in one group."""
    d = kit.table(spark, "/root/testdata/sf0.01", "documents")
    root = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(d).collect()}
    bags = {}
    for r in d.collect():
        w = words(r.text)
        if w:
            bags[r.doc_id] = collections.Counter(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4)))
    holders = collections.defaultdict(list)
    for i, bag in bags.items():
        for g in bag:
            holders[g].append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) < 200 for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in pairs if (both := (bags[a] & bags[b]).total()) >= 0.8 * (bags[a].total() + bags[b].total() - both)]
    found = sum(root[a] == root[b] for a, b in linked)
    assert len(linked) > 50 and found >= 0.9 * len(linked)


def test_near_duplicates_of_shared_ids(spark):
    r = random.Random(8)
    a, b = prose(r, 200), prose(r, 200)
    df = docs(spark, [(1, a), (1, b), (1, b), (2, b + " tail"), (3, a + " tail"), (4, prose(r, 90))])
    got = sorted((x.doc_id, x.component_id, x.kept) for x in bag_minhash.near_duplicates(df).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]
    assert sorted(x.text for x in bag_minhash.deduplicated(df).where("doc_id < 4").collect()) == sorted([a, b])


def test_signatures_estimate_weighted_jaccard():
    rng, m = np.random.default_rng(6), 2000
    el = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    sig = bag_minhash.signatures(np.repeat([0, 1], 60), np.concatenate([el, el]), np.concatenate([a, b]), np.array([a.sum(), b.sum()], float), m)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)]
    root = {x: x for p in pairs for x in p}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, kit.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert {x: got.get(x, x) for x in root} == {x: top(x) for x in root}


# --- 9 ---


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, prose(r, 4), "abc"[i % 3 if i % 4 else 0]) for i in range(900)] + [(None, None, None), (5000, "x", "d"), (5000, "x", "d")]
    df = docs(spark, rows)
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, "d": 0.0}
    out = poisson_mix.mixed(df, weights, other=0.1, wanted=4000, numbered=True).collect()
    n = collections.Counter(x.source for x in out)
    assert n["d"] == 0 and abs(n["b"] / n["a"] - 2) < 0.25 and abs(len(out) - 4000) < 250
    rate = {x["src"]: x["rate"] for x in poisson_mix.rates(df, weights, 0.1, 4000).collect()}
    copies = collections.Counter(x.doc_id for x in out)
    for i, t, s in rows[:50]:
        def u(*more):
            key = "|".join(["17", str(i), hashlib.md5(t.encode()).hexdigest()])
            return (int(hashlib.md5("|".join([key, *more]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = cdf = np.exp(-rate[s])
        k = 0
        while cdf < u():
            k += 1
            p *= rate[s] / k
            cdf += p
        assert copies[i] == k
    assert [x.doc_id for x in out] != sorted(x.doc_id for x in out if x.doc_id is not None)
    assert poisson_mix.mixed(df.limit(0)).count() == 0 and poisson_mix.mixed(df).columns == df.columns
    big = poisson_mix.mixed(docs(spark, [(1, "x")]), wanted=3000).count()
    assert abs(big - 3000) < 300


# --- 10 ---


def test_columns_of_like_names(spark):
    """copy_no, n_lines and n_dropped take the place of input columns of these names."""
    df = docs(spark, [(i, "menu\nx" + str(i), "h") for i in range(6)]).withColumn("copy_no", F.lit("old")).withColumn("N_LINES", F.lit("old")).withColumn("n_dropped", F.lit("old"))
    out = poisson_mix.mixed(df, numbered=True)
    assert sum(c.lower() == "copy_no" for c in out.columns) == 1 and {type(r.copy_no) for r in out.collect()} == {int}
    out = line_dedup.without_boilerplate(df, counts=True)
    assert sum(c.lower() in ("n_lines", "n_dropped") for c in out.columns) == 2 and {(r.n_lines, r.n_dropped, r.copy_no) for r in out.collect()} == {(2, 1, "old")}


def test_odd_rows_of_texts(spark):
    """Empty tables, null texts and ids, repeated rows and clashing names in the operators that go text by text."""
    rows = [(1, "mail a.b@c.de"), (1, "mail a.b@c.de"), (None, None), (2, None), (3, ""), (4, "\n"), (5, "x" * 70_000 + " a@b.cd")]
    df = docs(spark, rows).withColumn("spans", F.lit("old")).withColumn("n_tokens", F.lit("old")).withColumn("labels", F.lit("old"))
    tagger = char_crf.Tagger(3)
    for run, n in ((lambda d: pii.personal_data(d, tagger), "n_email"), (lambda d: tree_bpe.encode_documents(d, PATH, public_tokenizers.PATTERN), "n_tokens"), (licenses.scan, "n_words")):
        got = run(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        assert {r[n] for r in got if r.doc_id in (None, 2, 3)} == {0} and len({tuple(r)[1:3] for r in got if r.doc_id == 1}) == 1
        assert run(df.limit(0)).count() == 0
    assert [r.n_email for r in pii.personal_data(df, tagger).where("doc_id = 5").collect()] == [1]
    fitted = pii.fit(df.limit(0), windows=40, epochs=1)  # no background texts
    assert pii.personal_data(df, fitted).count() == len(rows)


def test_line_dedup(spark):
    rows = [(i, f"menu\nunique {i}\n\nmenu\nfoot {i % 2}", "h") for i in range(10)] + [(100, "menu\nx", "other"), (101, None, "h"), (102, "", "h"), (103, "menu", None), (104, "menu", "h"), (104, "menu", "h")]
    df = docs(spark, rows)
    for few in (500_000, 0):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.without_boilerplate(df, ratio=0.4, broadcast_lines=few, counts=True).collect()}
        assert got[3] == ("unique 3\n\nfoot 1", 5, 2) and got[100] == ("menu\nx", 2, 0)
        assert got[101] == (None, 0, 0) and got[102] == ("", 1, 0) and got[103] == ("menu", 1, 0) and got[104] == ("", 1, 1)
    out = line_dedup.without_boilerplate(df)
    assert out.columns == df.columns and out.count() == len(rows) and line_dedup.without_boilerplate(df.limit(0)).count() == 0


# --- pipeline ---


def test_pipeline_lines_of_small_hosts(spark):
    import corpus_pipeline

    df = docs(spark, [(i, f"menu\nunique {i}", "h") for i in range(4)] + [(9, "menu", "other")]).withColumn("n_chars", F.lit(0).cast("long"))
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert got == {i: f"unique {i}" for i in range(4)} | {9: "menu"}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    base = prose(r, 90)
    rows = [(i, prose(r, 40), "ab"[i % 2]) for i in range(20)] + [(i, prose(r, 20), "z") for i in range(100, 140)] + [(50, base, "z"), (51, base, "p"), (52, base + " tail", "q"), (None, prose(r, 30), None), (60, None), (61, ""), (62, "!"), (63, " ".join(["long"] * 30_000)), (50, base, "z")]
    full = docs(spark, rows).withColumn("row", F.lit("r")).withColumn("copy_no", F.lit(7))
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for n, (d, some) in enumerate(((full, labels), (full, labels.limit(0)), (full.limit(0), labels))):
        folder = f"{tmp_path}/{n}"
        some.write.parquet(f"{folder}/labels.parquet")
        d.write.parquet(f"{folder}/documents.parquet")
        now = kit.table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, kit.stored(stage(spark, now, folder))
            assert now.columns == d.columns, name
            ids = {x.doc_id for x in now.select("doc_id").collect()}
            if n < 2 and name != "mixing":
                assert {None, 60, 61, 62, 63, 50} <= ids, name
            if n < 2 and name == "MinHash near-dedup":
                assert 51 not in ids and 52 not in ids and now.where("doc_id = 50").count() == 1
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and (out.count() > 0) == (n < 2)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    d = kit.table(spark, folder, "documents")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = kit.stored(stage(spark, d, folder))
        assert d.columns == columns and d.count(), name
    out = corpus_pipeline.STAGES[-1][1](spark, d, folder)
    run = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(out) == key(run) and out.count() == d.count()
