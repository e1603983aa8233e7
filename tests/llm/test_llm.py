"""The training-data operators against brute force on small tables, with the odd cases of each."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF_DIR, connect, differ
from pyspark.sql import functions as F

from sheetweave.llm import chat, ego, jaccard, lm, mixing, packing, pseudonyms, quality, queries, token_rules, tokens, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string, rep long, size long, block long"


def docs_frame(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "xx", s, 0, "clash", 7, 7, 7) for i, t, s in zip(ids, texts, sources, strict=True)], DOC)


def words(n, seed=0, vocab=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, n))


ODD = [None, "", "   \n\t", "one", "É ß 漢字 <|im_end|> <|endoftext|>", words(30_000, 3), words(60, 1), words(60, 1), "x" * 20_000]


# --- op1 ---

def test_url_filter_sql(spark):
    assert differ(spark, connect(), queries.op1_url_filter, queries.SQL["op1_url_filter"]) == ""


def test_url_filter_cases(spark):
    urls = ["HTTPS://WWW.A.com/fr/x/?utm_source=1&b=2#f", "http://b.net", None, "no scheme", "http://b.net/y/", "http://b.net/y", "http://b.net/y", "x://", "http://sub.org/a\nb?q"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, block string")
    listed = spark.createDataFrame([("b.net/y",), (None,), ("b.net/y",)], "canonical_url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed, queries.RULES).collect()}
    assert len(got) == len(urls)
    assert (got[0]["host"], got[0]["path"], got[0]["canonical_url"], got[0]["rule"]) == ("www.a.com", "/fr/x/", "a.com/fr/x?b=2", "com/fr/")
    assert [got[i]["verdict"] for i in range(9)] == ["allow", "allow", "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert (got[2]["host"], got[3]["path"], got[1]["path"], got[8]["rule"]) == ("", "", "", "org/")
    for limit in (0, 1 << 20):  # joined by block, and broadcast
        same = url_filter.judge_urls(pages, listed, queries.RULES, broadcast_bytes=limit)
        assert {r["page_id"]: r["verdict"] for r in same.collect()} == {k: v["verdict"] for k, v in got.items()}
    assert url_filter.judge_urls(pages.limit(0), listed, queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    n = url_filter.block_count(5000)
    asked = url_filter.bloom_probe(spark.range(20000).select(F.concat(F.lit("k"), "id").alias("k"), "id"), "k", url_filter.bloom_blocks(keys, "k", n), n)
    assert asked.where("id < 5000 and not _maybe").count() == 0
    assert asked.where("id >= 5000 and _maybe").count() < 15000 * 0.02


# --- op2 ---

def brute_base(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked)


def test_token_rules(spark):
    texts = [*ODD, "a b c a b c a b\n#|\n#|\n \n", "a b c d " * 40, "\x1c\x85 a\x1cb\x0bc", "漢字 " * 80]
    got = {r["doc_id"]: r for r in token_rules.judge(docs_frame(spark, texts), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, i
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])
    assert not got[6]["kept"] and got[6]["byte_share"] == 0  # w17 w311 ... is no prose
    italian = "La mattina il mercato apre presto e le strade del centro si riempiono di gente che cerca frutta, pane e formaggi freschi. Un vecchio pescatore racconta ai bambini storie del mare, mentre una donna sistema i fiori davanti alla porta della sua bottega. Verso mezzogiorno il sole scalda le pietre della piazza, e molti tornano a casa per preparare il pranzo con calma."
    assert token_rules.judge(docs_frame(spark, [italian]), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model")).first()["kept"]
    noise = token_rules.judge(docs_frame(spark, ["".join(chr(0x1F300 + i % 60) for i in range(4)) + " z" + str(i) for i in range(1)]), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model")).first()
    assert noise["byte_share"] > 0.3 and noise["script"] == "other"
    assert token_rules.judge(docs_frame(spark, ["x"]).limit(0), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_token_rules_catch_junk(spark):
    """On the labels that the bands were not set by."""
    rows = {r["doc_id"]: r for r in queries.op2_token_rules(spark, SF_DIR).collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert all(rows[d]["kept"] for d, q in marks.items() if q == 1 and not rows[d]["base_failed"])
    assert sum(not rows[d]["kept"] for d, q in marks.items() if q == 0) > 0.6 * sum(q == 0 for q in marks.values())


def test_fertility_by_hand(spark):
    """The three measures and the verdict, token by token with the public libraries."""
    import base64

    import sentencepiece
    import tiktoken

    path, pieces_path = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id % 25 = 3").collect()
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(-1, "Привет, как дела сегодня? " * 30 + " ".join(map(str, range(60))), None), (-2, "漢字仮名 " * 60, "ja"), (-3, " ".join(chr(0x1F300 + i) for i in range(80)), "en"), (-4, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    bpe = token_rules.fertility(path, pieces_path).bpe
    assert isinstance(bpe, tiktoken.Encoding) and base64  # what reads the ranks is the public library
    for r in token_rules.judge(df, path, pieces_path).collect():
        _, text, lang = next(d for d in docs if d[0] == r["doc_id"])
        ids = Counter(bpe.encode_ordinary(text or ""))
        n = sum(ids.values())
        bits = -sum(k / n * np.log2(k / n) for k in ids.values())
        got = [pieces.is_byte(i) for w in (text or "").encode("utf-8", "surrogatepass").split() for i in pieces.encode(w.decode("utf-8", "replace"))]
        assert r["chars_per_token"] == pytest.approx(len(text or "") / n if n else 0) and r["token_entropy"] == pytest.approx(bits, abs=1e-9)
        assert r["byte_share"] == pytest.approx(sum(got) / len(got) if got else 0)
        lo, hi, share, low, high = token_rules.BANDS.get(lang) or token_rules.BANDS[r["script"]]
        assert r["kept"] == (not r["base_failed"] and (n < 50 or (lo <= r["chars_per_token"] <= hi and r["byte_share"] <= share and low <= bits <= high)))
    assert [token_rules.script_of(d[1] or "") for d in docs[-4:]] == ["cyrillic", "cjk", "other", "latin"]


def test_token_rules_bands_reject(spark):
    prose = words(200, 5)
    bands = {"latin": (1.2, 8.0, 0.15, 99.0, 100.0), "other": (0, 99, 1, 0, 99), "en": (1.2, 8.0, 0.15, 99.0, 100.0)}
    assert not token_rules.judge(docs_frame(spark, [prose]), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model"), bands=bands).first()["kept"]


# --- op3 ---

def test_encoder_equals_tokenizers():
    bpe = tokens.byte_bpe(queries.vocabulary("byte_bpe_50k.json"))
    for t in [t for t in ODD if t] + ["  a\n\n b\xa0 c \x1c d\x85\x85 e", "it's we'll '’s  \t x", "<|endoftext|>a"]:
        assert bpe.ids(t).tolist() == bpe.tok.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    texts = [*ODD, *(words(n, n) + ". Next one! " + words(n // 2, n + 1) for n in range(1, 300, 7))]
    pieces = packing.pack(docs_frame(spark, texts).repartition(3), queries.vocabulary("byte_bpe_50k.json"), run_tokens=20_000).collect()
    bpe = tokens.byte_bpe(queries.vocabulary("byte_bpe_50k.json"))
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_seq[p["sequence_id"]].append(p)
    assert len(of_doc) == len(texts)
    for i, t in enumerate(texts):
        mine = sorted(of_doc[i], key=lambda p: p["start"])
        assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine)])[:-1].tolist()
        assert np.frombuffer(b"".join(p["ids"] for p in mine), "<u4").tolist() == [*bpe.ids(t or "").tolist(), 0]
        assert {p["doc_tokens"] for p in mine} == {len(bpe.ids(t or "")) + 1}
    total = pad = 0
    for seq in of_seq.values():
        seq.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in seq] == np.cumsum([0, *(p["length"] for p in seq)])[:-1].tolist()
        n = sum(p["length"] for p in seq)
        assert n <= 1024
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else 1024 - n)
    assert pad < 0.06 * total
    assert packing.pack(docs_frame(spark, ["x"]).limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.cumsum([0, *rng.integers(1, 9, 14)]).tolist()
        cost = [0.0, *rng.integers(0, 5, 14).astype(float).tolist()]
        window = 16
        best = [0.0] + [1e9] * (len(at) - 1)
        powers = [1 << k for k in range(window.bit_length()) if window >> 4 <= 1 << k <= window]
        for j in range(1, len(at)):
            for i in range(j):
                if (n := at[j] - at[i]) <= window:
                    best[j] = min(best[j], best[i] + (0 if n in powers else window - n) + cost[j] + packing.EACH)
        cuts = packing.windows(at, cost, window)
        ends = dict(zip(at, cost, strict=True))
        paid = sum((0 if b - a in powers else window - (b - a)) + ends[b] + packing.EACH for a, b in zip([0, *cuts], cuts, strict=False))
        assert abs(paid - best[-1]) < 1e-9


# --- op4 ---

def test_language_model(spark):
    texts = [*ODD, *(words(80, s, 30) for s in range(40))]
    df = docs_frame(spark, texts, ids=[*range(len(texts) - 1), None])
    rows = lm.score(df, ~lm.held_out()).collect()
    assert len(rows) == len(texts)
    toks = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i in [*range(len(texts) - 1), None]]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    two = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in zip([b""] + t[:-1], t, strict=True))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = toks[r["doc_id"] if r["doc_id"] is not None else -1]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * (1 + abs(r["base_score"]))
        assert r["score"] < 0
    known = [r for r in rows if not r["train"] and r["n_tokens"] > 50]
    assert known and sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    # every score again, from counts by hand and an EM of its own
    three = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in zip(([b"", b""] + t)[: len(t)], ([b""] + t)[: len(t)], t, strict=True))
    n_train = sum(not h for h in held)

    def before(t):
        for i, w in enumerate(t):
            u, x = (t[i - 2] if i > 1 else b""), (t[i - 1] if i else b"")
            yield w, (x, w), (u, x, w), c[x] if i else n_train, two[(u, x)] if i else n_train

    def middle(p):
        return 2.0 ** (-(min(62, int(np.floor(-2 * np.log2(p)))) + 0.5) / 2) if p > 0 else 0.0

    def em(events, k):  # (bucket, estimates)
        out, events = {}, Counter(events)
        for bucket in {None} | {b for b, _ in events}:
            w = [1 / k] * k
            own = [(p, times) for (b, p), times in events.items() if bucket in (None, b) and sum(p) > 0]
            for _ in range(60):
                shares = [[times * a * b / sum(x * y for x, y in zip(w, p, strict=True)) for a, b in zip(w, p, strict=True)] for p, times in own]
                w = [sum(s[j] for s in shares) / sum(times for _, times in own) for j in range(k)]
            w = [max(x, 1e-6) for x in w]
            out[bucket] = [x / sum(w) for x in w]
        for b, w in out.items():
            if b == 0:
                out[b] = [0.0] + [x / sum(w[1:]) for x in w[1:]]
        return lambda b: out.get(b) or (out[None] if b else [0.0] + [1 / (k - 1)] * (k - 1))

    ratio = lambda x, y: x / y if y > 0 else 0.0
    trained = [x for t, h in zip(toks, held, strict=True) if not h for x in before(t)]
    w2 = em([((c1 - 1).bit_length(), (middle(ratio(two[b] - 1, c1 - 1)), middle((c[w] - 1) / (n - 1)), 1 / (v + 1))) for w, b, _, c1, _ in trained], 3)
    p2 = lambda w, b, c1, less: sum(x * y for x, y in zip(w2((max(c1 - less, 0)).bit_length()), (ratio(two[b] - less, c1 - less), (c[w] - less) / (n - less), 1 / (v + 1)), strict=True))
    w3 = em([((c2 - 1).bit_length(), (middle(ratio(three[g] - 1, c2 - 1)), middle(p2(w, b, c1, 1)))) for w, b, g, c1, c2 in trained], 2)
    for r in rows:
        t = toks[r["doc_id"] if r["doc_id"] is not None else -1]
        want = sum(np.log10(sum(x * y for x, y in zip(w3(c2.bit_length()), (ratio(three[g], c2), p2(w, b, c1, 0)), strict=True))) for w, b, g, c1, c2 in before(t))
        assert r["score"] == pytest.approx(want, rel=1e-6, abs=1e-6)
    # the same with many small chunks and several levels of nodes
    assert Counter((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in lm.score(df.repartition(3), ~lm.held_out(), chunk_bytes=2000, fan=2).collect()) == Counter((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in rows)
    assert lm.score(df.limit(0), ~lm.held_out()).count() == 0
    untrained = lm.score(df, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(abs(r["score"]) < 1e-9 for r in untrained)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(2)
    p2, p1 = rng.uniform(0.1, 0.9, 4000), rng.uniform(0.001, 0.05, 4000)
    cells = (3 * lm.BINS + lm.binned(p2)) * lm.BINS + lm.binned(p1)
    w = lm.learn_weights(cells, np.ones(4000), 10**6)
    assert abs(w.sum(1) - 1).max() < 1e-9 and w[3, 0] > 0.95 and w[0, 0] == 0


# --- op5 ---

def test_quality(spark):
    good = [words(120, s) + "." for s in range(60)]
    bad = ["".join(f"W{x}!! " for x in range(s, s + 90)).upper() for s in range(60)]
    texts = good + bad + ODD
    df = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(3, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    ranker = quality.fit(df, labels.where("doc_id is null or doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df.select("doc_id", "text"), ranker).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i < 60) for i in range(1, 120, 3)]) > 0.95
    none = quality.fit(df, labels.limit(0))
    assert {r["score"] for r in quality.score(df.select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score(df.limit(0), ranker).count() == 0
    twice = docs_frame(spark, [*texts, "Another text. " * 30], ids=[*range(len(texts)), 3])
    assert quality.fit(twice.repartition(7), labels).w.tolist() == quality.fit(twice.repartition(2), labels).w.tolist()
    assert quality.score(df.withColumn("score", F.lit("x")).select("doc_id", "text", "score"), ranker).count() == len(texts)


def test_quality_minimises_the_loss():
    """No small step from the weights lowers the mean logistic loss of the pairs and the ridge, computed pair by pair."""
    rng = np.random.default_rng(1)
    y = np.array([1] * 40 + [0] * 30)
    x = rng.normal(size=(70, quality.FEATURES)) + y[:, None] * 0.5
    ranker = quality.Ranker(x, y, pairs=400)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -4, 4)
    z = np.hstack((z, z * z))
    draw = np.random.default_rng(5)
    good = draw.permutation(40)[np.arange(400) % 40]
    pairs = list(zip(good, 40 + draw.integers(0, 30, 400), strict=True))
    loss = lambda w: np.mean([np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in pairs]) + 1e-3 / 2 * w @ w
    low = loss(ranker.w)
    assert all(loss(ranker.w + e * d) > low for d in np.eye(len(ranker.w)) for e in (1e-2, -1e-2))
    scores = 1 / (1 + np.exp(-(z @ ranker.w - np.quantile(z @ ranker.w, 30 / 70))))
    assert np.allclose(ranker.score(x), scores, atol=1e-9)


def test_quality_learns_from_all_pairs(spark):
    """Weights, threshold and scores against all pairs of all labelled rows, one by one, however rows are dealt and blocks cut."""
    rng = np.random.default_rng(2)
    texts = [words(int(rng.integers(5, 60)), i) + " A1!" * int(rng.integers(0, 9 if i % 3 else 4)) for i in range(200)]
    y = np.array([int(i % 3 == 0) for i in range(200)])
    df, labels = docs_frame(spark, texts), spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(y)], "doc_id int, quality int, toxic int")
    ranker = quality.fit(df, labels)
    x = np.array([quality.features(t) for t in texts])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -4, 4)
    z = np.hstack((z, z * z))
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    assert np.abs(-(d / (1 + np.exp(d @ ranker.w))[:, None]).mean(0) + 1e-3 * ranker.w).max() < 1e-6
    cut = np.quantile(z @ ranker.w, (y == 0).mean())
    assert np.isclose(ranker.cut, cut, atol=1e-9) and np.allclose(ranker.score(x), 1 / (1 + np.exp(cut - z @ ranker.w)), atol=1e-9)
    small = quality.fit(df.repartition(5), labels, block_rows=2, bloom_bytes=0)  # 100 blocks, added up in two steps; no id is ruled out
    assert np.allclose(small.w, ranker.w, atol=1e-6) and np.isclose(small.cut, ranker.cut, atol=1e-6)
    assert small.w.tolist() == quality.fit(df.repartition(3), labels, block_rows=2).w.tolist()
    one = quality.fit(df, labels.where("quality = 1"))
    assert not one.known and not quality.fit(df.where("doc_id < 0"), labels).known


def test_quality_learns_from_all_rows(spark):
    """Means and deviations are those of all labelled rows, here more than 20,000."""
    n = 22_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b"), F.repeat(F.lit(" cd"), (F.col("id") % 7).cast("int")), F.when(F.col("id") % 2 == 0, "!").otherwise(".")).alias("text"))
    ranker = quality.fit(df, spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5 < 4).cast("int").alias("quality")))
    x = np.array([quality.features("a b" + " cd" * (i % 7) + ".!"[i % 2 == 0]) for i in range(14)])[np.arange(n) % 14]
    assert np.allclose(ranker.mean, x.mean(0), rtol=1e-9) and np.allclose(ranker.sd, x.std(0) + 1e-9, rtol=1e-6, atol=1e-8)
    z = quality.spread(x, ranker.mean, ranker.sd) @ ranker.w
    assert np.isclose(ranker.cut, np.quantile(z, (np.arange(n) % 5 == 4).mean()), atol=1e-9)


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SF_DIR).where("held_out").collect()}
    marks = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r["doc_id"] in got]
    assert len(marks) > 80 and np.mean([a == b for a, b in marks]) > 0.9


# --- op6 ---

def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    vecs = [v + rng.normal(scale=0.12, size=8) for v in base for _ in range(6)]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vecs)]
    rows += [(900, rows[0][1], 1), (900, rows[0][1], 1), (901, None, 1), (902, [0.0] * 8, 1), (903, [1.0, None] * 4, 1), (904, [float("nan")] * 8, 1), (905, [1.0, 2.0], 1), (906, [1e200, 2e200], 1), (907, [], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    for block in (16, 2048):
        got = ego.near_vectors(df, block=block).collect()
        assert len(got) == len(rows)
        x = [np.array(r[1], float) if r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1]) else None for r in rows]
        x = [v / 2.0 ** np.frexp(np.abs(v).max())[1] if v is not None else None for v in x]
        link = np.array([[a is not None and b is not None and len(a) == len(b) and i != j and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9 for j, b in enumerate(x)] for i, a in enumerate(x)])
        want = Counter((r[0], int(link[i].sum())) for i, r in enumerate(rows))
        assert Counter((r["vec_id"], r["n_links"]) for r in got) == want
        comp = list(range(len(rows)))
        for _ in rows:
            comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
        least = defaultdict(list)
        for i, k in enumerate(comp):
            least[k].append(rows[i][0])
        assert Counter((rows[i][0], min((y for y in least[k] if y is not None), default=None)) for i, k in enumerate(comp)) == Counter((r["vec_id"], r["component_id"]) for r in got)
    assert ego.near_vectors(df.limit(0)).count() == 0


def test_embeddings_with_a_rest(spark):
    """More dimensions than the boxes have: what they leave out skips blocks, and loses no link; blocks are cut by bytes."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(scale=0.06, size=(7, 24)) for c in rng.normal(size=(50, 24)) * np.linspace(3, 0.3, 24)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    for block_bytes in (8 * 24 * 20, 8 << 20):
        got = {r["vec_id"]: r["n_links"] for r in ego.near_vectors(df, block_bytes=block_bytes).collect()}
        assert [got[i] for i in range(len(x))] == want and max(want) > 5


# --- op7 ---

PII = ["mail É.07@mail8.example.com, (212) 555-0199 or +1 (017) 555-7713.", "card 4111 1111 1111 1111 and 7086638319846192", "2020-02-29 31.12.1999 31.02.1999", "ip 10.0.255.3 and 300.1.1.1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "TOKEN 9233A8ECF7C5B09FE5949719B6B82BC439E9329B!!", "again 4111 1111 1111 1111 é.07@mail8.example.com ...q.7@a.de", "no 123 data", "7086638319846192" * 3000, "Des +1 (826) 555-4081 190.137.223.204 du +44 20 7946 0958 10.11.12.13 +4420794609 (212) 555-0198 7086638319846193"]


def test_pseudonyms(spark):
    texts = PII + [t for t in ODD]
    df = docs_frame(spark, texts)
    out = pseudonyms.pseudonymise(df, "key")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert (got[i]["text"] is None) == (t is None) and (i in (3, 9) or len(got[i]["text"] or "") == len(t or ""))
    for secret in ("07@mail8", "555-7713", "555-0199", "4111 1111", "7086638319846192 ", "2020-02-29", "31.12.1999", "10.0.255.3", "04dbebab", "9233A8EC"):
        assert not any(secret in (got[i]["text"] or "") for i in range(7)), secret
    for secret in ("555-4081", "190.137", "7946 0958", "10.11.12", "20794609", "555-0198", "7086638319846193"):
        assert secret not in got[9]["text"], secret
    assert "31.02.1999" in got[2]["text"] and "300.1.1.1" in got[3]["text"] and got[7]["text"] == PII[7]
    assert got[1]["text"][5:24] == got[6]["text"][6:25]  # equal values stay linked
    digits = [int(c) for c in got[1]["text"][5:24] if c.isdigit()]
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(out.drop("n_pseudonyms"), "key", undo=True).collect()}
    assert back == dict(enumerate(texts))
    other = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(df, "other").collect()}
    assert other[0] != got[0]["text"]
    assert pseudonyms.pseudonymise(df.limit(0), "key").count() == 0


def test_pseudonyms_permute(spark):
    df = spark.range(2000).select("id", F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pseudonyms.pseudonymise(df, "k").select("text").distinct().count() == 2000


def test_pseudonyms_check_cards(spark, tmp_path):
    """The query and the pipeline rewrite card numbers with a right Luhn digit and leave other long numbers alone."""
    import corpus_pipeline as cp

    texts = ["card 4111 1111 1111 1111 or 4845168114407329.", "order 9807915762804490, 4111 1111 1111 1112 and 12345678901234"]
    df = docs_frame(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op7_pseudonyms(spark, str(tmp_path)), cp.personal_data(spark, df, "")):
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got[1] == texts[1] and "4111 1111" not in got[0] and "4845168114407329" not in got[0]
    back = pseudonyms.pseudonymise(queries.op7_pseudonyms(spark, str(tmp_path)).drop("n_pseudonyms"), queries.PSEUDONYM_KEY, undo=True, checked=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_pseudonyms_phones_and_lengths(spark):
    """Formats of several countries, values of any length, letters of other scripts; the key is in no plan."""
    values = ["+33 6 12 34 56 78", "06 12 34 56 78", "612 345 678", "(030) 1234567", "+49 (30) 123 45 67", "0123456789abcdef" * 20, "k" * 400 + "@mail.example.org", "иван.петров@mail.example.org", "αβγδ@mail.example.org"]
    df = spark.createDataFrame([(i, f"a {v}, b", "x", "y") for i, v in enumerate(values)] + [(99, "in 100 200 300 and 12 34, 612 345 678 901 b", "x", "y")], "doc_id long, text string, _found string, _s string")
    out = pseudonyms.pseudonymise(df, "a very secret key")
    assert out.columns == [*df.columns, "n_pseudonyms"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, v in enumerate(values):
        mine = got[i]["text"][2:-3]
        assert mine != v and len(mine) == len(v) and got[i]["n_pseudonyms"] == 1, v
        assert mine.split("@")[0] != v.split("@")[0], v
    assert got[99]["text"] == "in 100 200 300 and 12 34, 612 345 678 901 b" and got[0]["_found"] == "x"
    assert {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(out, "a very secret key", undo=True).collect()} == {r["doc_id"]: r["text"] for r in df.collect()}
    for mode in ("extended", "formatted"):
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        assert "very secret" not in plan and "very secret".encode().hex() not in plan.lower()


def test_pseudonyms_by_hand(spark):
    """The permutation of a secret, computed with hmac."""
    import hmac

    def turn(digits, key):
        n = len(digits)
        l, r = digits[: n // 2], digits[n // 2 :]
        for rnd in range(pseudonyms.ROUNDS):
            mine, other = (r, l) if rnd % 2 == 0 else (l, r)
            seed = hmac.new(key, f"{rnd}|hex|{','.join(map(str, other))}|{len(mine)}".encode(), "sha256").hexdigest()
            mine = [(x + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % 16 for i, x in enumerate(mine)]
            l, r = (l, mine) if rnd % 2 == 0 else (mine, r)
        return l + r

    values = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "0" * 31 + "f", "abc" * 77 + "0"]
    got = [r["text"] for r in pseudonyms.pseudonymise(docs_frame(spark, values), "k").orderBy("doc_id").collect()]
    assert got == ["".join(f"{x:x}" for x in turn([int(c, 16) for c in v], b"k")) for v in values]


# --- op8 ---

def near_texts():
    base = [words(150, s) for s in range(12)]
    out = []
    for s, b in enumerate(base):
        rng = np.random.default_rng(100 + s)
        for k in range(7):
            w = b.split()
            for _ in range(k):
                w[rng.integers(0, len(w))] = f"new{k}"
            out.append(" ".join(w))
    return out


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(sets)
    link = [[j for j in range(n) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(n)]
    return [len(x) for x in link], comp


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard(spark, block):
    texts = [*ODD, *near_texts(), "A b C d e f", "a B c D e f"]
    got = {r["doc_id"]: r for r in jaccard.join_near(docs_frame(spark, texts), block=block).collect()}
    links, comp = brute_near(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(texts)))


def test_jaccard_ids(spark):
    texts = [words(40, 1), words(40, 1), words(40, 2), words(40, 2), words(40, 3)]
    got = jaccard.join_near(docs_frame(spark, texts, ids=[5, 5, 5, None, None])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got) == Counter([(5, 5, 1, True)] * 3 + [(None, 5, 1, False), (None, None, 0, True)])
    assert jaccard.join_near(docs_frame(spark, ["x"]).limit(0)).count() == 0


def test_prefix_shortens_to_the_recall(spark, monkeypatch):
    for target in (0.9, 0.999):
        d = jaccard.depth_for(0.8, 24, target)
        assert 1 - (1 - 0.8**d) ** 24 >= target > 1 - (1 - 0.8 ** (d + 1)) ** 24
    depths, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda tasks, threshold, trees, depth, before: depths.append(depth) or verify(tasks, threshold, trees, depth, before))
    close = [words(400, s) + tail for s in range(8) for tail in ("", " x", " y")]  # similar by 0.99 or so: long prefixes do
    assert [r["n_links"] for r in jaccard.join_near(docs_frame(spark, close)).collect()] == [2] * 24
    assert depths == [8]
    depths.clear()
    jaccard.join_near(docs_frame(spark, close + near_texts())).count()
    assert depths[0] == 8 and depths[-1] in (6, 7) and depths == sorted(depths, reverse=True)


def test_jaccard_recall_on_the_table(spark):
    """All links of a whole table, by brute force over an index of shingles."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r["text"] or "").lower().encode().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    shared = Counter()
    for ds in index.values():
        shared.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    links = Counter()
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in queries.op8_jaccard(spark, SF_DIR).collect()}
    assert len(got) == len(rows) and all(got[d] <= links[d] for d in got)
    assert sum(got.values()) >= 0.999 * sum(links.values()) > 100


def test_a_recall_out_of_reach_is_an_error():
    assert jaccard.depth_for(0.3, 24, 0.999) == 1
    with pytest.raises(ValueError, match="more trees"):
        jaccard.depth_for(0.2, 24, 0.999)


# --- op9 ---

def test_targets():
    assert mixing.targets([10, 10], [5, 1]) == pytest.approx([100 / 6, 20 / 6])
    assert mixing.targets([1, 99], [5, 2]) == pytest.approx([3, 97])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mixing(spark):
    rng = np.random.default_rng(9)
    texts = [words(int(n), int(n)) for n in rng.integers(0, 300, 400)] + [None, "", "x", "x"]
    ids = [*range(400), 400, 400, 7, None]
    sources = [*(["s0", "s1", "s2", "s3"][min(3, int(k))] for k in rng.integers(0, 9, 400)), None, None, "s1", "s1"]
    df = docs_frame(spark, texts, ids, sources)
    rows = mixing.mix(df, block=64)[0].collect()
    size = [len((t or "").split()) for t in texts]
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(zip(ids, size, strict=True))
    per = defaultdict(int)
    for s, n in zip(sources, size, strict=True):
        per[s] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([per[s] for s in names], [5, 2, 1, 5, 2][: len(names)]), strict=True))
    got = defaultdict(int)
    for r in rows:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] += r["taken"]
    for s in names:
        assert abs(got[s] - want[s]) <= 1
    again = mixing.mix(df.repartition(5), block=64)[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    slots = mixing.mix(df, block=64)[1].collect()
    assert len({(r["k"], r["rank"]) for r in slots}) == len(slots)
    share = Counter(r["k"] for r in slots if r["slot"] < len(slots) // 2)  # any stretch of the schedule has the mix
    for k, s in enumerate(names):
        assert abs(share[k] / (len(slots) // 2) - want[s] / sum(want.values())) < 0.05
    assert mixing.mix(df.limit(0))[0].count() == 0


# --- op10 ---

def test_chat(spark):
    convs = [(1, 1, "assistant", "  <|im_end|>\\<|x <\\| é漢\n"), (1, 0, "user", "hi"), (2, 0, "assistant", None), (3, 5, "user", "a"), (3, 5, "assistant", "b"), (3, None, "system", "s"), (None, 0, "assistant", "n"), (4, 0, None, words(5000)), (4, 1, "assistant", words(5000, 2)), (5, 0, "assistant", ""), (5, 1, "assistant", ".<|im_sep|>"), (5, 1, "assistant", ".<|im_sep|>")]
    df = spark.createDataFrame([(*c, "clash") for c in convs], "conv_id long, turn long, role string, text string, ids string")
    out = chat.format_chats(df, queries.vocabulary("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(convs, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for s in ("<|", "<\\|", "<\\\\|im|>", "a<b|c"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    assert chat.digests(chat.format_chats(df.limit(0), queries.vocabulary("byte_bpe_50k.json"))).count() == 0


def test_chat_offsets():
    """As tokenizers gives them with the marks added as special tokens."""
    from tokenizers import AddedToken, Tokenizer, processors

    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (chat.START, chat.SEP, chat.END)])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    for turns in ([("user", "hi  é漢字🙂 x\n\n y"), ("assistant", "<|im_end|> ok.")], [("assistant", "")], [("a", "🙂🙂 \t z" * 50)]):
        text, _ = chat.render(turns)
        want = tok.encode(text, add_special_tokens=False)
        ids, starts, ends = chat.encoder(path).encode(text)
        assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


# --- pipeline ---

def test_near_duplicates_odd_ids(spark):
    """One row of each component stays, whatever the ids: null in part or in whole, or used for another text too."""
    import corpus_pipeline as cp

    texts = near_texts() + [words(80, 900), words(80, 900), None, ""]
    comp = brute_near(texts)[1]
    n = len(texts)
    of = {t: comp[i] for i, t in enumerate(texts)}
    for ids in ([None] * n, [None if i % 3 else i for i in range(n)], [i % 5 for i in range(n)], [5 if i % 2 else None for i in range(n)]):
        left = cp.near_duplicates(spark, docs_frame(spark, texts, ids=ids), "").collect()
        assert Counter(of[r["text"]] for r in left) == Counter(set(comp))
        for r in left:
            group = [ids[i] for i in range(n) if comp[i] == of[r["text"]]]
            assert r["doc_id"] == min((i for i in group if i is not None), default=None)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    good = near_texts()
    texts = good + [words(120, s) + " é.07@mail8.example.com." for s in range(200, 215)] + ["".join(f"W{x}!! " for x in range(s, s + 90)).upper() for s in range(30)]
    df = docs_frame(spark, texts, sources=[f"s{i % 3}" for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, int(i < len(texts) - 30), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near duplicates", "personal data", "source mix", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.columns)
    assert all(c == df.columns for c in kept[:4])
    ids = [[r[0] for r in spark.read.parquet(f"{tmp_path}/{k}").select("doc_id").collect()] for k in range(4)]
    assert sorted(ids[0]) == list(range(len(texts) - 30))
    comp = brute_near(texts[: len(texts) - 30])[1]
    assert sorted(ids[1]) == sorted(set(comp))
    assert sorted(ids[2]) == sorted(ids[1])
    assert not spark.read.parquet(f"{tmp_path}/2").where("text like '%.07@mail8%'").count()
    keyed = spark.read.parquet(f"{tmp_path}/2").withColumn("key", F.xxhash64("doc_id", "text", "source"))  # rows are mixed by what they hold, not by ids alone
    share = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(keyed.select(F.col("key").alias("doc_id"), "source", "text"))[0].collect()}
    taken = {r["doc_id"]: share[r["key"]] for r in keyed.collect()}
    times = Counter(ids[3])
    assert set(times) <= set(taken) and all(int(t) <= times[k] <= int(t) + (t % 1 > 0) for k, t in taken.items())
    assert sum(r["length"] for r in docs.collect()) == sum(r["doc_tokens"] for r in docs.collect() if r["start"] == 0)
    assert json.dumps(sorted({r["doc_id"] for r in docs.collect()})) == json.dumps(sorted(set(ids[3])))
    assert cp.run(spark, SF_DIR.replace("sf0.01", "sf0.001")).count() > 0


def test_source_mix_meets_its_targets(spark):
    """Measured after the stage: each source's words, with repeated, null and equal ids."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    n = 1500
    texts = [words(int(k), 5000 + i) for i, k in enumerate(rng.integers(1, 120, n))] + [None, ""]
    sources = [["a", "b", "c", None][min(3, int(k))] for k in rng.integers(0, 7, n)] + ["a", "b"]
    ids = [None if i % 9 == 0 else i % 700 for i in range(n + 2)]
    df = docs_frame(spark, texts, ids, sources)
    out = cp.source_mix(spark, df, "")
    assert out.columns == df.columns
    got, per = Counter(), Counter()
    for t, s in zip(texts, sources, strict=True):
        per[s] += len((t or "").split())
    rows = out.collect()
    for r in rows:
        got[r["source"]] += len((r["text"] or "").split())
    names = sorted(per, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, mixing.targets([per[s] for s in names], [5, 2, 1, 5]), strict=True):
        assert abs(got[s] - t) < 0.05 * t, s
    most = Counter(r["text"] for r in rows)
    assert max(most.values()) <= 4 and Counter(map(tuple, cp.source_mix(spark, df.repartition(5), "").collect())) == Counter(map(tuple, rows))
    assert cp.source_mix(spark, df.limit(0), "").count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    """Every stage with null, empty and very long texts, repeated rows, no rows, and columns of clashing names."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = [words(80, i) if i % 2 else "W!! " * 60 for i in range(60)] + ODD
    df = docs_frame(spark, texts, ids=[*range(60), 7, 7, None, None, *range(64, 69)]).withColumn("score", F.lit("x")).withColumn("_times", F.lit("y")).withColumn("taken", F.lit(1))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert {r["text"] for r in out.select("text").collect()} <= set(texts) | {"x" * 20_000}
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert cp.packing(spark, df, str(tmp_path)).select("doc_id").distinct().count() == len({*range(60), None, *range(64, 69)})
