import collections
import random
import re
import zlib

import numpy as np
import pytest

from rulespark.llm import decontaminate, language_id, lm_score, near_dup, packing, sharding, stages, substring_dedup, toxicity, url_filter, vector_search

TEXTS = [None, "", "!!! ...", "one", "The quick brown fox jumps over the lazy dog today", "Élan Ñu\x0bx", "a " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, tiny and long texts, repeated rows, a null id, and extra columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", 0.5, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, TEXTS[4], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, size int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefg") + str(rng.randrange(500)) for _ in range(60)) for _ in range(n)]


def test_url_rules(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1?q", "https://m.example.com/en/1", "ftp://x.net/es/", "http://net/fr/a#b", "http://a.com", None, "nothing", "http://xcom/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()}
    assert got == {0: ("a.com", "com/", "allow"), 1: ("www.example.com", "www.example.com/en/", "allow"), 2: ("m.example.com", "example.com/en/", "block"), 3: ("x.net", "net/es/", "block"), 4: ("net", "net/fr/", "block"), 5: ("a.com", None, "allow"), 6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("xcom", None, "allow")}


def test_sharding(spark, odd, none):
    assert sharding.shard_by_bytes(none).count() == 0
    rows = sharding.shard_by_bytes(odd, 4).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {16}
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(TEXTS[4].encode())}) == 1


def test_differencing():
    sizes = np.random.default_rng(0).integers(1, 1000, 500)
    parts = np.zeros((500, 8), np.int64)
    parts[:, 0] = sizes
    where, sums = sharding.difference(parts)
    assert (np.bincount(where[:, 0], weights=sizes, minlength=8) == sums).all()
    assert sums.max() - sums.min() < 10


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, cache = Tokenizer.from_file(path), packing.tokenizer_cache(path)
    for t in [*[x for x in TEXTS if x], "Ça l'ÉTÉ it's <|endoftext|> a\x1cb İ ﬁ 北京 12³ ΣΑΣ ×÷", "'s''ll x\x85y"]:
        assert np.frombuffer(cache.text(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert packing.pack(packing.tokenised_pieces(none, path)).count() == 0
    rows = packing.pack(packing.tokenised_pieces(odd, path, 512), 512).collect()
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 512
    assert len(rows) == odd.count() + 5


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(10):
        lens = rng.integers(0, 200, 5)
        ranges = np.concatenate([[0], np.cumsum(lens)])
        scores = (rng.standard_normal((ranges[-1], 3)) * 3).astype(np.float32)
        path = language_id.viterbi(scores, ranges, 4.0)
        for a, b in zip(ranges[:-1], ranges[1:], strict=True):
            if a < b:
                v = scores[a].astype(float)
                for t in range(a + 1, b):
                    v = scores[t] + np.maximum(v, v.max() - 4)
                own = scores[np.arange(a, b), path[a:b]].sum() - 4 * (np.diff(path[a:b]) != 0).sum()
                assert abs(own - v.max()) < 1e-2


def test_language(spark, odd, none):
    assert language_id.identify(none).count() == 0
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2))
    assert got[4][0] in ("en", "fr")


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t + (" scum vile" if i % 4 == 0 else "")) for i, t in enumerate(corpus(240))], "doc_id long, text string")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, labels.limit(0)).collect())


def shingle_set(text):
    w = words(text)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(g, n) for g, k in c.items() for n in range(k)}


def test_near_duplicates(spark, odd, none):
    texts, rng = corpus(60), random.Random(2)
    for i in range(60):
        w = texts[i % 12].split()
        w[rng.randrange(60)] = "edit"
        texts.append(" ".join(w) + " .")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert near_dup.near_duplicates(none).count() == 0
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and sum(r["keep"] for r in rows if r["class_id"] == 4) == 1


def test_no_pair_of_a_bucket_is_missed(spark):
    """One bucket of 90 pairs that are similar to each other alone: leaders alone would find few of them."""
    sets = spark.createDataFrame([(k, [1000 * (k // 2) + j for j in range(19 + k % 2)]) for k in range(180)], "key long, items array<int>")
    rows = spark.createDataFrame([(7, k, 20, 180, 180) for k in range(180)] + [(8, k, 20, 180, 3) for k in range(3)], "bucket long, key long, n long, weight long, size long")
    links, roots = near_dup.linked(rows, rows.select("bucket").limit(1), lambda pairs: sets, 0.8)
    assert sorted(map(tuple, links.collect())) == [(k, k + 1) for k in range(0, 180, 2)]
    assert {r["node"]: r["root"] for r in roots.collect()} == {k: k - k % 2 for k in range(180)}


def test_substrings(spark, odd, none):
    passage = " ".join(f"p{i}" for i in range(52))
    texts = corpus(40)
    docs = [(i, t + " " + passage + " " + t[::-1] if i < 10 else t) for i, t in enumerate(texts)] + [(100, passage), (101, passage.replace("p0 ", "q0 "))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.repeats(docs)
    assert {r["doc_id"] for r in got.collect()} == {*range(10), 100, 101}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert passage in left[0] and all(passage not in left[i] for i in range(1, 10)) and left[20] == texts[20]
    assert substring_dedup.repeats(none).count() == 0
    assert substring_dedup.remove_repeats(odd).count() == odd.count()
    # rows without id lose passages of their own texts only
    apart = spark.createDataFrame([(1, passage), (None, texts[1] + "\n" + passage), (None, texts[2]), (None, passage + "\n" + texts[3])], "doc_id long, text string")
    left = sorted(r["text"].strip() for r in substring_dedup.remove_repeats(apart).collect())
    assert left == sorted([passage, texts[1], texts[2], texts[3]])


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(32)]) for i in range(400)] + [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32), (403, [None] * 32), (404, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([r[1] for r in rows[:400]], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in sorted(vector_search.nearest(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(range(0, 400, 50))
    hit = sum(len(set(own) & set(np.argsort(-np.where(np.arange(400) == q, -9, u @ u[q]))[:5])) for q, own in got.items())
    assert hit >= 0.9 * 5 * len(got)
    assert vector_search.nearest(df.limit(0)).count() == 0


def test_decontamination(spark, odd, none, tmp_path):
    items = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short Item"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(0, "x W1, w2 w3 w4 w5 w6 w7 w8 w9 w10 y"), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 z"), (2, "a short-item b"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {0: (12, 10, 1), 1: (10, 0, 0), 2: (4, 2, 1), 3: (0, 0, 0)}
    assert decontaminate.contamination(none, bench).count() == 0
    # a stage judges rows by their texts: ids may be null or repeat
    bench.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", 1), (None, "clean", 2), (7, "a short item b", 3), (7, "also clean", 4), (8, None, 5)]
    left = stages.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, source long"), str(tmp_path))
    assert sorted(r["source"] for r in left.collect()) == [2, 4, 5] and left.columns == ["doc_id", "text", "source"]
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_lm_scores(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate(corpus(80))), "doc_id long, text string")
    count = collections.Counter()
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            count.update([*r["text"].split(), None])
    n, v = sum(count.values()), len(count)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in lm_score.score_texts(docs).collect():
        toks = [*texts[r["doc_id"]].split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(t in count for t in toks), n)
        assert abs(r["base_score"] - sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)) < 1e-6
        assert r["score"] < 0
    assert lm_score.score_texts(none).count() == 0
    assert lm_score.score_texts(odd).count() == odd.count()


def spans_of(got):
    """Byte ranges reported for each document."""
    out = collections.defaultdict(list)
    for r in got:
        out[r["doc_id"]].append((r["begin"], r["end"], r["first_doc"]))
    return out


def test_passage_over_short_lines(spark):
    """A passage of 50 words over lines of 5 to 13 words is reported whole, however its lines break."""
    rng, own = random.Random(5), [t.split() for t in corpus(6, seed=9)]
    passage = [f"p{i}" for i in range(50)]

    def broken(w, least, most):
        lines, at = [], 0
        while at < len(w):
            n = rng.randint(least, most)
            lines.append(" ".join(w[at : at + n]))
            at += n
        return "\n".join(lines)

    texts = [broken(o[:30] + passage + o[30:], 5, 13) for o in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans_of(substring_dedup.repeats(docs).collect())
    for i, t in enumerate(texts):
        assert {w for b, e, _ in got[i] for w in words(t[b:e])} == set(passage)
        assert {f for _, _, f in got[i]} == {0}


def test_passage_in_longer_lines(spark):
    """Of passages of 50 words inside longer lines every word is reported; of edited copies, the edited words too."""
    own, texts = [t.split() for t in corpus(24, seed=10)], []
    for i, o in enumerate(own):
        passage = [f"x{i % 8}y{j}" for j in range(50)]
        if i >= 16:
            passage[25] = f"edit{i}"
        texts.append(" ".join(o[: 10 + i] + passage + o[10 + i :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans_of(substring_dedup.repeats(docs).collect())
    for i, t in enumerate(texts):
        whole = [(f, t[b:e].split()) for b, e, f in got[i] if e - b == max(y - x for x, y, _ in got[i])]
        assert {f for f, _ in whole} == {i % 8} and all(len(w) == 50 for _, w in whole), (i, whole)


def test_pieces_depend_on_their_document_alone():
    texts = [t.encode() for t in corpus(40, seed=11)]
    apart = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        apart.append(sorted(map(tuple, np.array(substring_dedup.units(data, np.array([0, len(t)]), False)[0])[1:5].T.tolist())))
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, begin, end, n, key, _ = substring_dedup.units(np.frombuffer(b"".join(texts), np.uint8), offs, False)[0]
    together = [sorted(zip((begin - offs[row])[row == i].tolist(), (end - offs[row])[row == i].tolist(), n[row == i].tolist(), key[row == i].tolist())) for i in range(40)]
    assert [[x[:3] for x in d] for d in together] == [[tuple(map(int, x[:3])) for x in d] for d in apart]


def test_links_are_those_compared(none):
    """The count leaves out pairs that share a leader, so it's not named as the number of similar texts."""
    assert near_dup.near_duplicates(none).columns == ["doc_id", "class_id", "links_compared", "keep"]


def test_near_dup_stage_judges_rows(spark):
    """Near-copies of null id go, and of one id's texts each is kept or not by itself."""
    a, b, c = corpus(3, seed=12)
    near = lambda t, n: " ".join([*t.split()[:-1], f"edit{n}"])
    rows = [(1, a), (None, near(a, 1)), (None, near(a, 2)), (None, b), (2, c), (2, near(a, 3)), (2, c), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, stages.near_dup(spark, docs, "").collect()))) == sorted(map(str, [(1, a), (None, b), (2, c), (None, None)]))
