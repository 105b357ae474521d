"""Operators against brute force, odd tables, and the whole pipeline."""

import collections
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from rulespark.llm import common_runs, decontaminate, graph, language_id, lm_score, near_dup, packing, runtime, sharding, stages, substring_dedup, toxicity, url_filter, vector_search
from rulespark.llm.wordhash import U, slices


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=120, seed=1, size=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefg") + str(rng.randrange(500)) for _ in range(size)) for _ in range(n)]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def similar(sets, similarity=0.8):
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]


# language models


def lm_docs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "a", "of", "red", "fox", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(80))) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = lm_docs(spark)
    one = {r["doc_id"]: r for r in lm_score.score_texts(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r for r in lm_score.score_texts(docs.repartition(16)).collect()}
    for i, r in one.items():
        assert r["n_tokens"] == many[i]["n_tokens"] and math.isclose(r["base_score"], many[i]["base_score"], rel_tol=1e-9)
        assert abs(r["score"] - many[i]["score"]) < 1e-3 * r["n_tokens"]


def small_model(spark, texts):
    model, vocabulary = lm_score.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    return model, {r["key"]: r["c"] for r in vocabulary.collect()}


def test_lm_factors_by_brute_force(spark):
    """Both softmaxes from the rows' weights one by one; over all words, the probabilities come to 1 less the unseen mass."""
    runtime.ship(spark)
    texts = [r["text"] for r in lm_docs(spark).collect()]
    model, counts = small_model(spark, texts)
    data = "the red fox of w1".encode()
    h, sfx, ranges = lm_score.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    place, _ = model.describe(h, sfx)
    slots = model.slots(h, place, ranges)
    for which in (0, 1):
        got = model.factor(which, slots[which], place)
        for t in range(len(h)):
            bias = model.bias[1][place[t] // lm_score.CELLS] if which else model.bias[0]
            z = [float(bias[k]) + sum(float(model.weights[which][s[t], k]) for s in slots[which]) for k in range(lm_score.CELLS)]
            target = place[t] % lm_score.CELLS if which else place[t] // lm_score.CELLS
            assert abs(got[t] - (z[target] - math.log(sum(map(math.exp, z))))) < 1e-4
    # every known word after "the red"
    total = 0.0
    keys = np.array(list(counts), np.int64).view(U)
    head = np.array([len(b"the red")])
    for k in keys:
        at = np.concatenate([h[:2], [k]])
        p, c = model.describe(at, np.concatenate([sfx[:2], [0]]))
        assert c[2] == counts[int(np.int64(k.view(np.int64)))]
        one, two = model.slots(at, p, np.array([0, 3]))
        logp = model.factor(0, one, p)[2] + model.factor(1, two, p)[2] - model.log_total[p[2]] * math.log(10) + math.log(c[2])
        total += math.exp(logp)
    assert abs(total - 1) < 1e-3 and head.size == 1


def test_lm_gradients_by_brute_force(spark):
    texts = [r["text"] for r in lm_docs(spark).collect()][:20]
    runtime.ship(spark)
    model, _ = small_model(spark, texts)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    class Held:
        value = model

    got = [np.zeros((model.rows, lm_score.CLASSES)), np.zeros((model.rows, lm_score.CELLS))]
    for b in lm_score._gradients(Held)([batch]):
        for tab, row, vals in zip(*(b.column(c).to_pylist() for c in ("tab", "row", "vals")), strict=True):
            if tab >= 0:
                got[tab][row] = np.frombuffer(vals, np.float32)
    want = [np.zeros_like(x) for x in got]
    for _, _, data, offs in slices(batch.column("text")):
        h, sfx, ranges = lm_score.tokens(data, offs)
        place, _ = model.describe(h, sfx)
        for which, slots in enumerate(model.slots(h, place, ranges)):
            for t in range(len(h)):
                z = (model.bias[1][place[t] // lm_score.CELLS] if which else model.bias[0]).astype(float)
                z = z + sum(model.weights[which][s[t]] for s in slots)
                g = -np.exp(z) / np.exp(z).sum()
                g[place[t] % lm_score.CELLS if which else place[t] // lm_score.CELLS] += 1
                for s in slots:
                    want[which][s[t]] += g
    for a, b in zip(got, want, strict=True):
        assert np.abs(a - b).max() < 1e-2


def blank_model(rows):
    zero = np.zeros(1, np.int64)
    model = lm_score.Model(np.zeros(1, U), zero, zero, np.zeros(1024, np.int64), np.zeros(1024), 1, 1, 0.1)
    model.rows = rows
    model.weights = np.zeros((rows, lm_score.CLASSES), np.float32), np.zeros((rows, lm_score.CELLS), np.float32)
    return model


def test_lm_training_does_not_pass_over_whole_tables():
    """A short text costs no more than the sums that a task holds, however large the tables are."""

    class Held:
        value = blank_model(1 << 15)

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c"])], ["text"])
    own = (1 << 15) * (lm_score.CLASSES + lm_score.CELLS) * 8
    for work in (lm_score._gradients, lm_score._start_counts):
        for _ in work(Held)([batch]):  # what is made once
            pass
        tracemalloc.start()
        for _ in work(Held)([batch]):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 1.25 * own


def test_lm_head_words_are_found():
    """Among hashes that crowd in one place, lie at both ends or repeat a prefix, as searchsorted finds them."""
    rng = np.random.default_rng(3)
    top = np.iinfo(np.uint64).max
    for keys in (rng.integers(0, top, 5000, U, True), np.arange(300, dtype=U), top - np.arange(300, dtype=U), np.array([0, top], U), np.array([7], U)):
        keys = np.unique(keys)
        sfx = rng.integers(0, 1024, len(keys))
        model = lm_score.Model(keys, np.arange(1, len(keys) + 1), sfx, rng.integers(0, 32, 1024), np.ones(1024), 10, 10, 0.1)
        asked = np.concatenate([keys, keys + U(1), keys - U(1), rng.integers(0, top, 2000, U, True)])
        slots = rng.integers(0, 1024, len(asked))
        place, count = model.describe(asked, slots)
        at = np.minimum(np.searchsorted(model.keys, asked), len(keys) - 1)
        known = model.keys[at] == asked
        assert np.array_equal(count, np.where(known, model.counts[at], 0))
        assert np.array_equal(place, np.where(known, model.places[at], model.slot_place[slots]))


def test_lm_rows_are_added_over_tasks():
    """Rows of tables, many times each and in any order, add up; tokens seen too."""
    rng = np.random.default_rng(4)
    want, batches = np.zeros((2, 128, 32)), []
    for seen in range(5):
        parts = [np.where(rng.random((128, 1)) < 0.5, rng.random((128, 32), np.float32), 0).astype(np.float32) for _ in range(2)]
        want += parts
        batches += list(lm_score._emitted(parts, seen))
    table = pa.Table.from_batches(batches)
    mixed = table.take(pa.array(rng.permutation(len(table)))).to_batches(max_chunksize=70)
    got, seen = np.zeros((2, 128, 32)), 0
    for b in lm_score._add(iter(mixed)):
        seen += int(b.column("seen").to_numpy().sum())
        for tab, row, vals in zip(*lm_score.unpacked(b), strict=True):
            assert not got[tab, row].any()
            got[tab, row] = vals
    assert seen == 10 and np.allclose(got, want, atol=1e-5)


def test_lm_learns_and_its_tables_grow(spark):
    """Words that follow each other in the training texts get more than their counts alone give."""
    rng = random.Random(4)
    pairs = [(f"left{i}", f"right{i}") for i in range(12)]
    texts = [" ".join(w for _ in range(20) for w in rng.choice(pairs)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in lm_score.score_texts(docs).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in rows) > 0.75 * sum(r["base_score"] for r in rows)
    zero = np.zeros(1, np.int64)
    sizes = [lm_score.Model(np.zeros(1, U), zero, zero, np.zeros(1024, np.int64), np.zeros(1024), n, 1, 0.1).rows for n in (10**5, 10**7, 10**8)]
    assert sizes[0] < sizes[1] < sizes[2]


# url filter


def test_urls_against_brute_force_and_odd_tables(spark, monkeypatch):
    rng = random.Random(6)
    hosts, paths = ["com", "a.com", "x.a.com", "net", "B.net", "", "a..com"], ["", "/", "/en/", "/en/x", "/fr/", "/e"]
    urls = [rng.choice(["http://", "", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q", "#f"]) for _ in range(200)] + [None, "http://a.com/en/"] + ["http://a.com/en/"] * 300
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("net", "/fr/", "block"), ("x.a.com", "/en/", "allow"), ("com", "/", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fit = [(h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")))

    want = [judged(u) for u in urls]
    for most in (100_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, table).collect()}
        assert [got[i] for i in range(len(urls))] == want
        assert url_filter.filter_urls(pages.limit(0), table).count() == 0
        assert {r["verdict"] for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}
    twice = pages.unionAll(pages.limit(1))
    assert url_filter.filter_urls(twice, table).count() == len(urls) + 1


# near-duplicates


def near_sets(rng, n):
    base = [rng.integers(0, 2**31, 40) for _ in range(4)]
    out = []
    for _ in range(n):
        s, k = base[rng.integers(0, 4)].copy(), rng.integers(0, 8)
        s[rng.choice(40, k, replace=False)] = rng.integers(0, 300, k)
        out.append(np.unique(s).astype(np.int32))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_links_inside_buckets_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = 60
    sets = near_sets(rng, n)
    ranges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    for buckets in (1, 3):
        bucket, root = np.sort(rng.integers(0, buckets, n)), rng.integers(0, n, n)
        want = [(i, j) for i, j in similar([set(x.tolist()) for x in sets]) if bucket[i] == bucket[j]]
        same = [(i, int(np.flatnonzero(root == root[i])[0])) for i in range(n)]
        found = [near_dup.joining_links(bucket, root, np.concatenate(sets), ranges, 0.8)]
        if buckets == 1:
            found.append(near_dup.joining_links_dense(root, np.concatenate(sets), ranges, 0.8))
        for links in found:
            assert {tuple(sorted(x)) for x in links} <= set(want)
            assert components(n, same + links) == components(n, same + want)


def test_large_buckets_are_split_by_further_bands(spark):
    rng = np.random.default_rng(1)
    sets = near_sets(rng, 80)
    frame = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sets)], "key long, items array<int>")
    rows = spark.createDataFrame([(1, k, len(s), 80, 80) for k, s in enumerate(sets)], "bucket long, key long, n long, weight long, size long")
    _, roots = near_dup.linked(rows, rows.select("bucket").limit(1), lambda pairs: frame, 0.8, cell=3000)
    want = components(80, similar([set(x.tolist()) for x in sets]))
    got = {r["node"]: r["root"] for r in roots.collect()}
    assert [got.get(k, k) for k in range(80)] == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 60, 61: 60}


def test_near_duplicates_odd_columns(spark):
    a, b = corpus(2, seed=20, size=4000)
    rows = [(1, a, 1, 2), (1, a, 1, 2), (None, a, 3, 4), (2, b, 5, 6), (3, None, 7, 8), (4, "", 9, 9), (5, "", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, bands long")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["keep"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == sorted([("1", "1", True), ("1", "1", False), ("None", "1", False), ("2", "2", True), ("3", "3", True), ("4", "4", True), ("5", "5", True)])


# packing


def packed(spark, pieces, length, per_block):
    frame = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return packing.pack(frame, length, per_block).collect()


def whole_sequences(rows, length):
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= length
    return len(at)


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 7, None]
    rows = packed(spark, [(i, 0, 0, 100, 2**32 - 1) for i in ids], 256, 40_000)
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
    assert whole_sequences(rows, 256) == 3 and {r["ids_crc32"] for r in rows} == {2**32 - 1}


def test_packing_repeated_rows_in_many_blocks(spark):
    full = [(1, 0, 0, 64, 5)] * 900 + [(2, 0, 0, 40, 6)] * 700 + [(3, 0, 0, 24, 6)] * 700
    rows = packed(spark, full, 64, 100)
    assert len(rows) == len(full)
    assert whole_sequences(rows, 64) <= 1600 * 1.01 + 3


def test_sum_of_squares_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        length = 12
        sizes = rng.integers(1, length + 1, 40)
        bins, offsets = packing.sum_of_squares(sizes, length)
        held = []  # tokens in each bin
        squares = lambda h: sum(c * c for r, c in collections.Counter(length - x for x in h).items() if r)
        for i in np.argsort(-sizes, kind="stable").tolist():
            s = int(sizes[i])
            choices = [squares([*held[:b], held[b] + s, *held[b + 1 :]]) for b in range(len(held)) if held[b] + s <= length] + [squares([*held, s])]
            b = int(bins[i])
            assert offsets[i] == (held[b] if b < len(held) else 0)
            if b == len(held):
                held.append(0)
            held[b] += s
            assert squares(held) == min(choices)


def test_other_tokenizers_take_the_long_way(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.splits_at_blanks(public_tokenizers.path("word_bpe_49k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.splits_at_blanks(path)
    texts = ["The  Quick brown\nfox 12's", None, "", "é ü"]
    rows = {r["doc_id"]: r for r in packing.tokenised_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (rows[i]["start"], rows[i]["length"], rows[i]["ids_crc32"]) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# sharding


def test_sharding_combines_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["x" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 900, 400))] + ["same text"] * 150
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(sharding, "FAN", 3)
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 20)
    rows = sharding.shard_by_bytes(docs, 4, groups_per_block=40).collect()
    total = collections.Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert len(rows) == len(texts) and max(total.values()) - min(total.values()) < 200
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"same text")}) == 1


# language


def test_letters_come_from_code_points():
    text = "“Abc” – ж’л 北京 ١٢ ñ·कि x́"
    data = np.frombuffer(text.encode(), np.uint8)
    kind, script = language_id.letters(data)
    at, names = 0, ["", *language_id.SCRIPTS]
    for ch in text:
        n = len(ch.encode())
        assert set((kind[at : at + n] == 1).tolist()) == {ch.isalpha()}, ch
        want = {"ж": "Cyrillic", "北": "Han", "ñ": "Latin", "क": "Devanagari", "A": "Latin"}.get(ch)
        assert want is None or names[script[at]] == want
        at += n


def test_marks_and_quotes_are_no_letters(spark):
    rows = [(0, "“ ” – …"), (1, "١٢٣ 45"), (2, "“слово”"), (3, "́́"), (4, "une phrase")]
    docs = spark.createDataFrame([(i, t, "fr") for i, t in rows] + [(i, "une autre phrase en français", "fr") for i in range(10, 30)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["has_letter"]) for r in language_id.identify(docs).collect()}
    assert [got[i] for i in range(5)] == [("und", False), ("und", False), ("fr", True), ("und", False), ("fr", True)]


def test_more_languages_than_a_byte_counts(spark):
    rows = [(10 * lang + k, f"{'abcdefghijklmnop'[lang % 16]}{'qrstuvwxyz'[lang // 16]}ly " * 30, f"l{lang:03}") for lang in range(140) for k in range(6)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]] and r["score"] == 1 for r in got)


def test_language_counts_by_brute_force(spark):
    texts = ["la maison est là", "the house is here", "l'été, la mer"]
    runtime.ship(spark)
    model = language_id.model_of(spark.createDataFrame([(t, k) for t, k in zip(texts, ["fr", "en", "fr"], strict=True)], "text string, lang string"))
    assert model["names"] == ["en", "fr"]
    counts = {"en": np.zeros(language_id.SLOTS), "fr": np.zeros(language_id.SLOTS)}
    for t, k in zip(texts, ["fr", "en", "fr"], strict=True):
        data = t.encode()
        _, _, pair, triple, word, *_ = language_id.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for slot in [*pair, *triple, *word]:
            counts[k][slot] += 1
    for j, k in enumerate(["en", "fr"]):
        for part, alpha in zip(range(3), language_id.ALPHA, strict=True):
            cut = slice(part << language_id.BITS, (part + 1) << language_id.BITS)
            c = counts[k][cut] + alpha
            assert np.allclose(model["logs"][cut, j], np.log(c / c.sum()), atol=1e-5)


def test_language_held_out(spark):
    """Documents of invented words of two alphabets' halves are told apart."""
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice(["aeiou", "bcdfg"][i % 2] + "lmn") for _ in range(5)) for _ in range(30)), ["v", "c"][i % 2]) for i in range(120)]
    held = [r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 10 and all(r["lang_pred"] == rows[r["doc_id"]][2] for r in held)


# toxicity


def test_risk_and_its_gradient_by_brute_force():
    rng = np.random.default_rng(8)
    soft = lambda t: math.log1p(math.exp(t))
    for shift in (0.0, -6.0):
        g_p, g_u, prior = rng.standard_normal(7) + 3, rng.standard_normal(9) + shift, 0.4
        positive = prior * np.mean([soft(-x) for x in g_p])
        negative = np.mean([soft(x) for x in g_u]) - prior * np.mean([soft(x) for x in g_p])
        dp, du, part = toxicity.risk_step(g_p, g_u, prior)
        assert abs(part - negative) < 1e-9
        # the whole risk while its second part isn't negative, else away from that part alone
        risk = (lambda p, u: prior * np.mean([soft(-x) for x in p]) + np.mean([soft(x) for x in u]) - prior * np.mean([soft(x) for x in p])) if negative >= 0 else (lambda p, u: -(np.mean([soft(x) for x in u]) - prior * np.mean([soft(x) for x in p])))
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            assert abs((risk(g_p + e, g_u) - risk(g_p - e, g_u)) / 2e-6 - dp[k]) < 1e-5
        for k in range(9):
            e = np.eye(9)[k] * 1e-6
            assert abs((risk(g_p, g_u + e) - risk(g_p, g_u - e)) / 2e-6 - du[k]) < 1e-5
        assert positive > 0


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_UNLABELLED", 20)
    docs = spark.createDataFrame([(1, "calm words here")] * 500 + [(i, f"word{i} " + ("vile " * (i % 3 == 0))) for i in range(2, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 100)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda slots, ranges, positive, prior: seen.append(len(positive)) or {"weights": np.zeros(1 << toxicity.BITS, np.float32), "bias": 0.0})
    runtime.ship(spark)
    assert toxicity.score_toxicity(docs, labels).count() == 598
    assert seen[0] <= 20 + 33


# substrings


def test_paragraphs_of_lines():
    """Every word is in a paragraph, but those of fewer than LEAST words between two paragraphs of a row."""
    rng = random.Random(9)
    for _ in range(200):
        lines = [rng.choice([0, 1, 3, 7, 19, 20, 45]) for _ in range(rng.randrange(12))]
        row = sorted(rng.randrange(3) for _ in lines)
        got = substring_dedup.paragraph_lines(np.array(lines, int), np.array(row, int))
        for r in range(3):
            own = [(a, b) for a, b in got if row[a] == r]
            assert all(row[b] == r for _, b in own)
            sizes = [sum(lines[a : b + 1]) for a, b in own]
            assert all(s >= substring_dedup.LEAST for s in sizes) or len(sizes) == 1
            mine = [i for i in range(len(lines)) if row[i] == r]
            edges = [mine[0] - 1 if mine else 0, *[x for ab in own for x in ab], mine[-1] + 1 if mine else 0]
            left = [sum(lines[a + 1 : b]) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            assert all(x < substring_dedup.LEAST for x in left) and (own or not sum(left))


def test_paragraphs_by_brute_force(spark):
    """Components of similar paragraphs, by Jaccard of five-word shingles, span the documents that are reported."""
    rng, base = random.Random(10), corpus(8, seed=30, size=30)
    docs = []
    for i in range(24):
        lines = []
        for _ in range(3):
            w = rng.choice(base).split() if rng.random() < 0.6 else corpus(1, seed=rng.random(), size=30)[0].split()
            for _ in range(rng.randrange(3)):
                w[rng.choice([0, 1, 28, 29])] = f"e{rng.randrange(9)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    flat = [(i, p) for i, t in docs for p in t.split("\n")]

    def shingles(p):
        w = words(p)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return {(g, n) for g, k in c.items() for n in range(k)}

    root = components(len(flat), similar([shingles(p) for _, p in flat]))
    held = collections.defaultdict(set)
    for (i, _), r in zip(flat, root, strict=True):
        held[r].add(i)
    want = sorted((i, words(p), min(held[r])) for (i, p), r in zip(flat, root, strict=True) if len(held[r]) > 1)
    got = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).where("kind <> 'run'").collect()
    texts = dict(docs)
    assert sorted((r["doc_id"], words(texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode()), r["first_doc"]) for r in got) == want
    assert "linked" in {r["kind"] for r in got} <= {"wording", "linked"}


def test_shared_runs_by_brute_force(spark):
    """Every word of a run of 44 words that an earlier document holds is in a reported span, wherever it stands."""
    rng = random.Random(11)
    texts = [t.split() for t in corpus(30, seed=31, size=120)]
    for _ in range(40):
        a, b = rng.sample(range(30), 2)
        n, at, to = rng.randrange(25, 70), rng.randrange(50), rng.randrange(50)
        texts[b][to : to + n] = texts[a][at : at + n]
    sep = lambda: rng.choice([" ", " ", "\n", ", "])
    docs = [(i, "".join(w + sep() for w in t)) for i, t in enumerate(texts)]
    got = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["begin"], r["end"]))
    size, first = common_runs.RUN + common_runs.LEAST, collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t) - size + 1):
            first[tuple(t[k : k + size])].add(i)
    missed = total = 0
    for i, text in docs:
        places = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", text)]
        for k in range(len(texts[i]) - size + 1):
            if len(first[tuple(texts[i][k : k + size])]) > 1:
                inside = [any(b <= x and y <= e for b, e in spans[i]) for x, y in places[k : k + size]]
                total += 1
                missed += not any(inside)
    assert total > 100 and missed == 0


def test_shuffle_files_go_with_their_write(spark, monkeypatch):
    """No table of common_runs leaves shuffle files, and no words around a run are written twice, though rows are repeated
    and texts copied."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_([0-9]+)_", disk.getAllFiles().mkString(" ")))
    left, edges, real = {}, [], common_runs.staged

    def staged(df, label):
        before = shuffles()
        out = real(df, label)
        until = time.time() + 5
        while (own := shuffles() - before) and time.time() < until:
            time.sleep(0.05)
        left[label] = own
        if label == "edges":
            edges.extend(r["spot"] for r in out.collect())
        return out

    monkeypatch.setattr(common_runs, "staged", staged)
    held = spark.conf.get(runtime.CLEANUP)
    base = corpus(12, seed=33, size=80)
    docs = [(i, f"{base[i % 12]} {base[(i + 1) % 12]}") for i in range(24)] + [(99 - i, f"{base[i]} end{i}") for i in range(12)]
    got = substring_dedup.repeats(spark.createDataFrame(docs * 2, "doc_id long, text string").repartition(7))
    assert got.where("kind = 'run'").count() > 20 and len(edges) == len(set(edges)) > 20
    assert {"shared_seeds", "edges", "extended"} <= set(left) and not any(left.values()), left
    assert spark.conf.get(runtime.CLEANUP) == held


def test_a_paragraph_that_is_a_whole_text_elsewhere_keeps_its_links(spark):
    """Document 1 holds a paragraph's words as a whole text of short lines, of which some are left over."""
    w = [f"w{i}" for i in range(29)]
    lines = [" ".join(w[:12]), " ".join(w[12:24]), " ".join(w[24:])]
    rows = [(1, "\n".join(lines)), (2, " ".join(w)), (3, " ".join([*w[:-1], "other"]))]
    for order in (rows, rows[::-1]):
        got = substring_dedup.repeats(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).where("kind = 'linked'").collect()
        assert {r["doc_id"] for r in got} == {1, 2, 3} and len({r["passage"] for r in got}) == 1


def test_seeds_and_repeats_by_brute_force():
    """Winnowed seeds, and repeats of values in rows, among hashes that repeat much or little."""
    rng = np.random.default_rng(6)
    for kinds in (2, 30, 10**9):
        ranges = np.concatenate([[0], np.cumsum(rng.integers(0, 70, 12))])
        h = rng.integers(0, kinds, ranges[-1]).astype(U)
        s, own = common_runs.shingles(h, ranges, common_runs.SEED)
        want = set()
        for row in range(12):
            for lo in range(own[row], own[row + 1] - common_runs.WIDTH + 1):
                place = max(range(lo, lo + common_runs.WIDTH), key=lambda i: (-int(s[i]), i))  # noqa: B023
                want.add((row, int(place - own[row]), int(s[place])))
        assert [tuple(int(v) for v in x) for x in zip(*common_runs.seeds(h, ranges), strict=True)] == sorted(want)
        e = substring_dedup.occurrences(h, ranges)
        turns = {}
        for row in range(12):
            seen = collections.Counter()
            for i in range(ranges[row], ranges[row + 1]):
                assert turns.setdefault((int(h[i]), seen[h[i]]), e[i]) == e[i]
                seen[h[i]] += 1
        assert len(set(turns.values())) == len(turns)


def test_remove_repeats_keeps_clashing_columns(spark):
    a, b = corpus(2, seed=32, size=40)
    rows = [(1, a, "s", "i", "h", 0, {"k": 1}), (2, a + "\n" + b, "s", "i", "h", 0, None), (3, None, None, None, None, 0, None), (2, a + "\n" + b, "t", "i", "h", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, __id string, __hash string, n_chars long, row map<string,int>")
    left = sorted(substring_dedup.remove_repeats(docs).collect(), key=str)
    assert left[0].__fields__ == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "").strip(), r["spans"], r["n_chars"]) for r in left if r["spans"]) == [(1, a, "s", len(a)), (2, b, "s", len(b) + 1), (2, b, "t", len(b) + 1)]
    assert [r["text"] for r in left if r["doc_id"] == 3] == [None]


# vectors


def test_vectors_odd_and_tied(spark):
    rows = [(0, [1e-200, 2e-200, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [1e200, 2e200, 0.0]), (2, [0.0, 0.0, 5.0]), (3, [2.0, 4.0, 0.0]), (4, [1.0, 0.0, 0.0]), (0, [3.0, 3.0, 3.0]), (50, [1.0, 1.0]), (51, [2.0, 2.0]), (None, [1.0, 2.0, 0.0]), (52, [float("inf"), 1.0, 1.0]), (53, []), (54, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, block int")
    got = collections.defaultdict(list)
    for r in sorted(vector_search.nearest(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert set(got) == {0, 50}
    assert got[50] == [(51, 1.0)]
    # one of the rows of id 0 asks; ids that repeat count once, ties go to the smaller
    assert [v for v, _ in got[0]] in ([1, 2, 3, 4], [1, 2, 3, 4][:4], [2, 1, 3, 4]) and all(math.isfinite(s) for _, s in got[0])


def test_vector_recall_with_clusters(spark):
    """Probes are as many as the true neighbours of a sample need: few for clustered vectors, and recall holds."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 24)) * 4
    x = centres[rng.integers(0, 40, 1500)] + rng.standard_normal((1500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vector_search.usable(df.select("vec_id", df["embedding"].alias("v")), "v")
    centroids, probes = vector_search.fit_lists(rows, 1500, 5)
    assert probes < len(centroids) / 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit, n = 0, 0
    got = collections.defaultdict(set)
    for r in vector_search.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        hit, n = hit + len(got[q] & set(np.argsort(-s)[:5].tolist())), n + 5
    assert hit >= 0.9 * n


# decontamination


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", most)
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(f"b{k}", " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 14])))) for k in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    for i in range(0, 40, 3):
        docs[i] = (i, docs[i][1] + " - " + rng.choice(items)[1].upper())
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for name, own in items:
            v = words(own)
            n = min(10, len(v))
            for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit |= set(range(k, k + n))
                        found.add(name)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(w), len(hit), len(found), bool(hit))


# the pipeline


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    texts = corpus(14, seed=40, size=70)
    passage = " ".join(f"q{i}" for i in range(60))
    near = " ".join([*texts[0].split()[:-1], "edit"])
    rows = [(i, t, None, "s", len(t), 1) for i, t in enumerate(texts)]
    rows += [rows[3], (20, near, None, "s", 0, 2), (None, texts[5], None, None, 0, 3), (21, None, None, "s", 0, 4), (22, "12 – “”", None, "s", 0, 5), (23, "", None, "s", 0, 6)]
    rows += [(30, texts[6][:200] + "\n" + passage, None, "s", 0, 7), (31, passage + "\nan own ending of this", None, "s", 0, 8), (32, "some item words here as they stand in the test set exactly so", None, "s", 0, 9)]
    rows += [(33, "é" * 200_000 + " a very long word", None, "s", 0, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([("i1", "Some item words here, as they stand in the TEST set"), ("i2", None)], "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows, passage


def test_pipeline_stages_and_run(spark, raw):
    """Unlabelled, null, empty, repeated, long and clashing rows through all stages; run() gives what the stages give."""
    base, rows, passage = raw
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = runtime.staged(stage(spark, docs, base), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"]
    # no label teaches a language: only texts without a letter go
    gone = {21, 22, 23}
    assert sorted(str(r["doc_id"]) for r in kept["language"]) == sorted(str(r[0]) for r in rows if r[0] not in gone)
    # the near copy, the repeated row and the copy without id go
    assert sorted(str(r["doc_id"]) for r in kept["near_dup"]) == sorted(map(str, [*range(14), 30, 31, 32, 33]))
    texts = {r["doc_id"]: r["text"] for r in kept["substring"]}
    assert len(texts) == 18 and passage in texts[30] and passage not in texts[31] and texts[31].strip() == "an own ending of this"
    assert {r["doc_id"] for r in kept["decontaminate"]} == {*range(14), 30, 31, 33}
    pieces = corpus_pipeline.run(spark, base).collect()
    digest = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert digest(pieces) == digest(kept["packing"])
    whole_sequences(pieces, 4096)
    by = collections.Counter()
    for r in pieces:
        by[r["doc_id"]] += r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert by == {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept["decontaminate"]}


def test_stages_on_empty_tables(spark, raw):
    base, _, _ = raw
    none = spark.read.parquet(f"{base}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, base).count() == 0
    assert stages.language(spark, none, base).columns == none.columns
