"""The training-data operators against brute force on small inputs, with their odd cases."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import language, licenses, mixing, near_dup, packing, quality_mil, quality_rules, queries, repeats, url_filter, vafile

ODD = (None, "", " \n\t", "a", "ü" * 3000, "same text here", "same text here")


def words(n, seed):
    r = random.Random(seed)
    return " ".join(
        r.choice(
            "the of and to in is was thing place water light stone river cloud number " .split()
        ) + str(r.randrange(400)) for _ in range(n)
    )


def test_quality_counts_match_brute_force(docs):
    texts = [*ODD, "a b c a b c a b c", "x\n\nx\n x\ny #$ <", words(300, 1) + "\n" + words(50, 2) + " " + words(50, 2)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(*texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        ), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs(*texts).limit(0)).count() == 0


def test_em_learns_which_rules_to_trust():
    # two rules agree, the third is noise
    patterns = [(2 + 3 * 2 + 9 * v, 450) for v in (0, 2)] + [(0 + 0 + 9 * v, 50) for v in (0, 2)]
    theta, prior = quality_rules.fit_em(patterns, 3)
    begin, says = quality_rules.log_odds(theta, prior)
    assert begin + says[0][2] + says[1][2] + says[2][0] > 2 and begin + says[0][0] + says[1][0] + says[2][2] < -2 and 0.8 < prior < 0.97
    assert abs(theta[2][1][2] - theta[2][0][2]) < 0.2


def test_posterior_decides_beside_the_base_rule(spark):
    """On the corpus table the posterior itself rejects documents, and the better for it."""
    d = "/root/testdata/sf0.01"
    rows = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(
        spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left"
    ).collect()
    passed = [r for r in rows if not r["base_failed"]]
    rejected = [r for r in passed if not r["kept"]]
    assert len(passed) / 50 < len(rejected) < len(passed) / 5
    known = [r for r in rows if r["quality"] is not None]
    right = lambda verdict: sum(verdict(r) == (r["quality"] == 1) for r in known) / len(known)
    assert right(lambda r: r["kept"]) > right(lambda r: not r["base_failed"]) + 0.04
    assert sum(r["quality"] == 1 for r in rejected) <= len(rejected) / 50


def test_quality_rules_on_long_texts_and_clashing_columns(spark):
    text = words(20_000, 3) + "\n" + "# " * 40_000
    names = ["doc_id", "text", "n_words", "pattern", "_w", "kept", "quality_prob"]
    df = spark.createDataFrame(
        [(1, text, *["x"] * 5), (None, text, *["y"] * 5)],
        ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)
    )
    rows = quality_rules.quality_rules(df).collect()
    assert [r["n_words"] for r in rows] == [60_000] * 2 and [r["n_symbols"] for r in rows] == [40_000] * 2 and all(
        r["base_failed"] for r in rows
    )
    counts = quality_rules.add_counts(spark.createDataFrame([("Ab c1 ### né 12 abcd",)], "text string")).first()
    assert (counts["n_letters"], counts["n_short_words"], counts["n_real_words"], counts["n_upper"]) == (9, 5, 5, 1)


def test_url_rules(spark):
    urls = [
        None, "", "nourl", "http://WWW.Example.com/en/x?q=/fr/", "https://a.example.com/en/#f", "http://example.net/es/1",
        "ftp://xnet/es/", "http://net/fr/", "http://a.spam-farm.example.org/x", "http://spam-farm.example.org", "http://h.com",
        "http://h.com/", "HTTP://u@H.NET:8/de/", "a://b://c/d"
    ]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {
        r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(
            pages, queries.url_rows(spark, queries.RULES), queries.url_rows(spark, queries.LISTED)
        ).collect()
    }
    rules = queries.RULES
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if "spam-farm" in host and path.startswith("/") else "allow")
        assert got[i] == (host, path, *rule), u


def brute_topk(rows, every=100, k=10):
    """Of (id, vector) rows, repeats included: {query id: [(rank, id, score)]}."""
    whole = [
        (i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = {}
    for q, a in whole:
        if q % every == 0:
            out.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])] for q, found in out.items() if found}


def topk_of(df, **given):
    got = {}
    for r in vafile.top_k(df, **given).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (450, 8)))]
    vecs += [(1000 + i, vecs[7][1]) for i in range(30)]  # ties
    vecs += [
        (2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2100, [float("inf")] * 8), (2200, [1.0, 2.0]),
        (2201, [3.0, 2.0]), (2300, []), (2400, []), (None, vecs[3][1])
    ]
    vecs += [(100, vecs[100][1])] * 3 + [(100, vecs[5][1])] + [(7, vecs[7][1])] * 12  # repeated ids, one with two vectors
    df = spark.createDataFrame(
        [(i, v, 0, 1.0, "x") for i, v in vecs], "vec_id long, embedding array<float>, label int, score double, m string"
    ).repartition(3)
    assert topk_of(df) == brute_topk(vecs) == topk_of(df, batch_bytes=700, first=0)
    assert vafile.top_k(df.limit(0)).count() == 0


def test_topk_of_a_very_common_vector(spark):
    rng = np.random.default_rng(3)
    common = [0.25] * 6
    vecs = [(i, common if i % 3 else [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(1500)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id long, embedding array<float>, label int").repartition(4)
    assert topk_of(df) == brute_topk(vecs)
    kept = vafile.distinct(vafile._integers(df, "vec_id", "embedding", 1024.0), 11, 10).count()
    assert kept <= 500 + 4 * 11


def test_cells_bound_and_leave_few():
    v = np.floor(1024 * np.random.default_rng(2).normal(0, 0.1, (5000, 32)))
    cells = vafile.Cells.of(v)
    upper, gap = cells.bounds(v[:40])
    true = v @ v[:40].T
    assert (upper >= true).all() and (upper - gap <= true).all()
    blocks = [(np.arange(a, a + 1000), np.zeros(1000, np.int64), vafile.Cells.of(v[a : a + 1000])) for a in range(0, 5000, 1000)]
    left = [np.concatenate(x) for x in zip(*vafile.scan(iter(blocks), {32: (v[:40], np.arange(40), np.arange(40))}, 10))]
    for q in range(40):
        best = [i for i in np.lexsort((np.arange(5000), -true[:, q])) if i != q][:10]
        assert set(best) <= set(left[1][left[0] == q])
    assert len(left[0]) < 40 * 5000 / 50
    huge = np.array([[9e18, -9e18], [1.0, 2.0], [-9e18, 9e18]])
    upper, gap = vafile.Cells.of(huge).bounds(huge)
    assert (upper >= huge @ huge.T).all() and (upper - gap <= huge @ huge.T).all()


def test_topk_beyond_doubles(spark):
    vecs = [(100, [1e5, 1.0]), (1, [1e5, 3.0]), (2, [1e5, 3.001]), (3, [-1e5, 0.0]), (4, [1e18, 0.0]), (5, [1e18, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id long, embedding array<double>, label int")
    got = topk_of(df, k=4)[100]
    assert got == [(1, 4, 2**63 - 1), (2, 5, 2**63 - 1), (3, 2, 102400000**2 + 1024 * 3073), (4, 1, 102400000**2 + 1024 * 3072)]


def test_near_duplicates_match_brute_force(docs):
    base = [words(120, s) for s in range(6)]
    texts = [
        *ODD, *base, base[0] + " tail", base[0].replace("the", "thy", 2), base[1], base[1] + " " + words(20, 99), "a b c",
        "a b c", "p q r s t " * 9, "p q r s t " * 10
    ]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(*texts)).collect()}
    bags = [np.unique(near_dup.shingles(t), return_counts=True) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_dup.similarity(bags[a], bags[b]) >= 0.8 or (texts[a] or "") == (texts[b] or ""):
                old, new = group[a], group[b]
                group = [min(old, new) if g in (old, new) else g for g in group]
    assert [got[i] for i in range(len(texts))] == group


def test_a_group_of_near_copies_loses_no_link(docs):
    # edits from none to a third of the words: some copies link to few others, some to none
    r, base = random.Random(5), words(150, 77).split()
    texts = [" ".join(f"e{i}x{j}" if r.random() < i / 1800 else w for j, w in enumerate(base)) for i in range(120)]
    got = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs(*texts)).collect()}
    bags = [np.unique(near_dup.shingles(t), return_counts=True) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_dup.similarity(bags[a], bags[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [min(old, new) if g in (old, new) else g for g in group]
    assert len(set(group)) > 10 and [got[i] for i in range(len(texts))] == group


def test_signatures_are_unbiased_and_whole():
    r = np.random.default_rng(3)
    a, b = ["w%d" % x for x in r.integers(0, 60, 400)], None
    b = a[:330] + ["v%d" % x for x in range(70)]
    x, y = (near_dup.shingles(" ".join(t)) for t in (a, b))
    s = near_dup.signatures([x, y, np.empty(0, np.uint64), x], 4000)
    true = near_dup.similarity(np.unique(x, return_counts=True), np.unique(y, return_counts=True))
    assert abs((s[0] == s[1]).mean() - true) < 0.04 and (s[0] == s[3]).all() and np.isinf(s[2]).all()
    heavy = near_dup.signatures([np.repeat(x[:1], 30), np.repeat(x[:1], 20)], 4000)
    assert abs((heavy[0] == heavy[1]).mean() - 2 / 3) < 0.04


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        m = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                m[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        out.append((len(r), int(m.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~m[:-1]].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("batch_spans", [4096, 2])
def test_repeats_match_brute_force(docs, batch_spans):
    p = words(60, 5)
    texts = [
        *ODD, "ü" * 90 + "x", words(40, 6) + p + words(30, 7), p + words(50, 8), words(10, 9) + p[40:320], "ab" * 300, "q" * 250,
        *[words(12, 20 + i) + p[100:330] + words(9, 40 + i) for i in range(12)], "é" * 120 + p[:250], "é" * 120
    ]
    got = {
        r["doc_id"]: (
            r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]
        ) for r in repeats.remove_repeats(docs(*texts), batch_spans=batch_spans).collect()
    }
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=160).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8))
def test_expansion_finds_all_shared_windows(spans):
    length = 40
    seen = Counter(s[i : i + length] for s in spans for i in range(len(s) - length + 1))
    want = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in spans]
    assert [f.tolist() for f in repeats.shared_windows(spans, np.zeros(len(spans), bool), length)] == want


def test_only_spans_without_shared_windows_are_left_out():
    r = np.random.default_rng(8)
    base = r.integers(97, 123, 900).astype(np.uint8).tobytes()
    texts = [
        r.integers(
            97, 123, int(r.integers(0, 90))
        ).astype(np.uint8).tobytes() + base[a : a + n] + b"-" * int(r.integers(0, 60)) for a, n in zip(r.integers(0, 500, 60), r.integers(120, 400, 60))
    ]
    spans, names = [], []
    for t in texts:
        for first, last, _, name in zip(*repeats.anchors(t, 200)):
            if t[first : last + 200] not in spans:
                spans.append(t[first : last + 200])
                names.append(name)
    seen = Counter((n, s[i : i + 200]) for s, n in zip(spans, names) for i in range(len(s) - 199))
    want = np.array([any(seen[n, s[i : i + 200]] > 1 for i in range(len(s) - 199)) for s, n in zip(spans, names)])
    kept = repeats.able(spans, np.array(names), 200)
    assert 0 < want.sum() < len(want) and kept[want].all() and not kept.all()


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [*ODD, words(900, 3), " lead", "two  spaces", "\n\n a \tb", "<|endoftext|> x", "½ ² don't"]
    rows = packing.pack_documents(docs(*texts), path, capacity=64, with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert all(
            r["length"] == 64 for r in own[1:]
        ) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum(
            [0, *[n for _, n in sorted(b)]]
        )[:-1].tolist() and sum(n for _, n in b) <= 64
    counts = np.bincount([r["length"] for r in rows], minlength=65)
    assert packing.lower_bound(counts, 64) <= len(bins) <= packing.lower_bound(counts, 64) + 1


def test_packing_gives_added_tokens_their_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    t = Tokenizer.from_file(path)
    texts = [
        "a<|endoftext|> x", "<|endoftext|><|endoftext|>", " <|endoftext|>\n<|endoftext|",
        words(80, 3) + "<|endoftext|>" + words(80, 4)
    ]
    rows = packing.pack_documents(docs(*texts), path, with_ids=True, added=True).collect()
    got = {r["doc_id"]: list(r["ids"]) for r in rows}
    assert got[0] == [64, 50256, 2124, 2] and got == {
        i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bounds_hold(sizes):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = fewest(rest[1:], [*bins, rest[0]])
        for i, b in enumerate(bins):
            if b + rest[0] <= 20:
                best = min(best, fewest(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]))
        return best

    bins, _ = packing.best_fit(np.array(sizes), 20)
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= fewest(sizes, []) <= bins.max() + 1


def test_repacking_exchanges_between_partitions(spark):
    r = np.random.default_rng(1)
    items = spark.createDataFrame([(int(x),) for x in r.integers(1, 700, 600)], "length long")
    rows = packing.pack(items, 1024, per_partition=100).groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")
    ).collect()
    total = items.agg(F.sum("length")).first()[0]
    assert all(x["n"] == x["end"] <= 1024 for x in rows) and len(rows) <= -(-total // 1024) + 3


def test_language_held_out(docs, spark):
    en, de = ("the river and the light of the stone ", "der fluss und das licht auf dem stein ")
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", "s") for i in range(60)] + [
        (100, None, "en", "s"), (101, "123 !", "de", "s"), (102, "the stone", None, "s")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.language_id(df).collect()}
    assert len(got) == 63 and all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.language_id(df.where("lang is null")).collect()} == {"und"}


def test_profile_ranks_by_count():
    codes = Counter(language.ngrams("abab ab").tolist())
    ranked = sorted(codes, key=lambda c: (-codes[c], c))
    assert language.profile("abab ab").tolist() == ranked and len(language.profile("1 2 -")) == 0


def test_quality_classifier(docs, spark):
    good = [words(150, i) + "." for i in range(60)]
    bad = [(words(150, 100 + i) + ".").upper().replace(" ", "!! ") for i in range(60)]
    df = docs(*[x for pair in zip(good, bad) for x in pair], None, "")
    labels = spark.createDataFrame(
        [(i, 1 - i % 2, 0) for i in range(120)] + [(500, None, 0)], "doc_id long, quality int, toxic int"
    )
    got = {r["doc_id"]: r for r in quality_mil.quality(df, labels).collect()}
    assert len(got) == 122 and all(
        got[i]["predicted"] == 1 - i % 2 for i in range(120)
    ) and 0 <= got[120]["score"] == got[121]["score"] <= 1
    assert {r["score"] for r in quality_mil.quality(df, labels.limit(0)).collect()} == {0.5}


def test_attention_merges_pieces_of_long_texts():
    model = quality_mil.AttentionMIL()
    model.p["w"][:] = 1.0
    text = words(3000, 4)
    whole = model.score([text])
    old, quality_mil.CHUNK = quality_mil.CHUNK, 3
    try:
        assert np.allclose(model.score([text]), whole)
    finally:
        quality_mil.CHUNK = old


def test_mixing_reaches_targets(docs, spark):
    texts = [words(100, i) + (" foul nasty" * 5 if i % 4 == 0 else "") for i in range(80)] + [None, ""]
    df = docs(*texts)
    labels = spark.createDataFrame([(i, "toxic" if i % 4 == 0 else "clean") for i in range(80)], "doc_id long, domain string")
    rows = mixing.mix(df, labels, {"clean": 0.9, "toxic": 0.1}).collect()
    sums = [sum(r["rate"] * r["n_tokens"] * r[c] for r in rows) for c in ("p_clean", "p_toxic")]
    assert len(rows) == 82 and abs(sums[1] / sum(sums) - 0.1) < 0.01 and all(r["rate"] >= 0 for r in rows)
    assert mixing.mix(df.limit(0), labels).count() == 0


def test_mixing_meets_each_target_of_overlapping_domains(spark):
    r = np.random.default_rng(4)
    p = np.concatenate([r.dirichlet((6, 1, 1), 600), r.dirichlet((1, 3, 1), 150), r.dirichlet((4, 0.5, 2), 60)])
    soft = spark.createDataFrame(
        [(int(n), [float(y) for y in x]) for n, x in zip(r.integers(20, 2000, len(p)), p)], "n_tokens long, p array<double>"
    )
    g, targets, reached = mixing.solve(soft, [0.9, 0.07, 0.03])
    assert np.allclose(np.array(targets) / sum(targets), [0.9, 0.07, 0.03]) and np.allclose(reached, targets, rtol=1e-4)
    sums = soft.agg(*[F.sum(mixing.rate_of(F.col("p"), g) * F.col("n_tokens") * F.col("p")[i]) for i in range(3)]).first()
    assert np.allclose(list(sums), targets, rtol=1e-4)


def test_mixing_tells_of_targets_out_of_reach(docs, spark):
    labels = spark.createDataFrame([(0, "clean"), (1, "toxic")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="doesn't meet its targets"):
        mixing.mix(docs("a b", "a b"), labels, {"clean": 0.9, "toxic": 0.1})


def test_mixing_stage_keeps_clean_documents_where_others_are_scarce(spark, docs, tmp_path):
    import corpus_pipeline

    texts = [words(100, i) + (" foul nasty" * 50 if i < 1 else "") for i in range(200)]
    spark.createDataFrame(
        [(i, 1, int(i < 1)) for i in range(200)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    taken = Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs(*texts), str(tmp_path)).collect())
    assert sum(i in taken for i in range(1, 200)) >= 197 and 2 <= taken[0] <= 5  # 3 % of the tokens, of which there is 1 %


def test_mixing_stage_keeps_null_ids(spark, docs, tmp_path):
    import corpus_pipeline

    texts = [words(100, i) for i in range(40)]
    spark.createDataFrame(
        [(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(*texts, texts[0], None, texts[30], ids=[*range(20), *[None] * 20, 0, None, None])
    out = corpus_pipeline.mixing_stage(spark, df, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_licenses_inherit_from_nearest(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "code"),
        (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/y.txt", "code\n# Licensed under CC BY-NC 4.0.\n" + words(80, 1)), (5, "z/x.txt", None), (6, None, "code"),
        (7, "top.txt", ""), (8, "a/w.txt", "a licensed plumber"), (8, "a/w.txt", "a licensed plumber")
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = [
        (
            r["doc_id"], r["license"], r["origin"], r["license_dir"]
        ) for r in licenses.license_scan(df, F.col("path")).orderBy("doc_id").collect()
    ]
    assert got == [
        (1, "MIT", "file", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "file", None),
        (4, "CC-BY-NC-4.0", "header", None), (5, None, None, None), (6, None, None, None), (7, None, None, None),
        (8, "MIT", "inherited", "a"), (8, "MIT", "inherited", "a")
    ]


def test_license_texts_and_headers_of_several_lines(spark):
    full = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    scanner = licenses.Scanner()
    for name, text in full.items():
        assert scanner.scan(text.replace("year, holder", "2020, Jane Doe"), 0.8, 0.8)[::2] == (name, True), name
    code = "\n" + words(200, 5).replace(" ", "\n") + "\n"
    wrapped = lambda text, mark="# ": "".join(
        mark + " ".join(text.split()[i : i + 9]) + "\n" for i in range(0, len(text.split()), 9)
    )
    for name, texts in licenses.HEADERS.items():
        for text in texts:
            assert scanner.scan("# Copyright 2020 Jane Doe\n#\n" + wrapped(text) + code, 0.8, 0.8)[::2] == (name, False), text
    for text, name in [
        (wrapped(full["MIT"], " * ") + code, "MIT"),
        ("Copyright 2020 Jane Doe. Licensed under the MIT License." + code, "MIT"),
        (
            "// Copyright 2015 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n" + code,
            "BSD-3-Clause"
        ),
        ("a license to\ndrive " + code, None),
        ("The licensed plumber has no copyright. All of the rest is prose." + code, None),
    ]:
        assert scanner.scan(text, 0.8, 0.8)[::2] == (name, False), text[:80]
    rows = [(1, "a/LICENSE", full["MIT"]), (2, "a/b/x.txt", "code")]
    got = licenses.license_scan(
        spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")
    ).orderBy("doc_id").collect()
    assert [(r["license"], r["origin"], r["license_dir"]) for r in got] == [("MIT", "file", None), ("MIT", "inherited", "a")]


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    texts = [words(150, i) for i in range(12)]
    df = docs(*texts, texts[0], None, "")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, df, "")
        assert out.columns == corpus_pipeline.COLUMNS
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert kept == set(range(12)) | {13}


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark, docs):
    import corpus_pipeline

    a, b, c, d = (words(150, i) for i in range(70, 74))
    # a row ingested twice; two texts under one id, one of them a copy; copies without an id; a class of null ids only
    df = docs(a, a, b, b + " tail", c, a, d, d, ids=[1, 1, 2, 3, 3, None, None, None])
    out = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(
        ((r["doc_id"], r["text"]) for r in out.collect()), key=str
    ) == sorted([(1, a), (2, b), (3, c), (None, d)], key=str)
    cut = corpus_pipeline.repeats_stage(spark, out, "").collect()
    assert {r["text"] for r in cut} == {a, b, c, d}


CLASH = "doc_id long, text string, {}"


def with_clashes(spark, rows, names):
    """(id, text) rows with further text columns of the given names."""
    return spark.createDataFrame(
        [(i, t, *["x"] * len(names)) for i, t in rows], CLASH.format(", ".join(f"`{n}` string" for n in names))
    )


def test_repeats_of_odd_tables(spark):
    p, q = words(60, 5), words(70, 6)
    rows = [(1, p), (1, p), (None, q), (None, q), (2, q + " tail"), (3, None), (4, ""), (5, words(80, 9))]
    df = with_clashes(spark, rows, ["row", "name", "span", "first", "n", "id", "at", "part", "cuts"])
    got = sorted(
        (
            (
                r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]
            ) for r in repeats.remove_repeats(df).collect()
        ),
        key=str
    )
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 200))), key=str)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_repeats_in_very_long_texts(spark):
    """Beyond the eight million bytes after which windows are gone through by pieces."""
    r = np.random.default_rng(11)
    long, p = r.integers(97, 123, 8_400_500).astype(np.uint8).tobytes().decode(), words(60, 5)
    rows = [(1, long[:8_388_600] + p + long[8_388_600:]), (2, p + words(40, 8)), (3, long[8_400_000:])]
    got = {
        x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.remove_repeats(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    n = len(p)
    assert got[3] == (500, 1) and got[1] == (n + 500, 2) and got[2][1] == 1 and n <= got[2][0] <= n + 3


def test_near_duplicates_of_odd_tables(spark):
    a, b = words(150, 1), words(150, 2)
    rows = [
        (1, a), (1, a), (None, a), (None, b), (2, b + " tail"), (3, None), (4, ""), (5, words(30_000, 9)),
        (6, words(30_000, 9) + " more")
    ]
    df = with_clashes(spark, rows, ["node", "comp", "key", "class_id", "bands", "n"])
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dup.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 3)] * 2 + [(None, 1, 3), (None, 2, 2), (2, 2, 2), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2)])
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_a_hot_class_and_a_hot_folder_keep_all_rows(spark):
    a = words(60, 1)
    df = spark.createDataFrame([(i, a if i % 2 else words(60, 100 + i)) for i in range(300)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: (1, 150) if i % 2 else (i, 1) for i in range(300)}
    files = [(0, "a/LICENSE", "Released under the MIT License.")] + [
        (i, f"a/b/{i}.txt" if i % 3 else f"c{i}/{i}.txt" if i % 2 else None, "code") for i in range(1, 200)
    ]
    rows = licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(200))
    assert all((r["license"] == "MIT") == (r["doc_id"] == 0 or r["doc_id"] % 3 != 0) for r in rows)


def test_licenses_of_odd_tables(spark):
    df = with_clashes(
        spark,
        [
            (1, "Released under the MIT License."), (None, None), (None, None),
            (2, words(50_000, 3) + "\n# Licensed under CC BY 4.0.\n" + words(50_000, 4))
        ],
        ["folder", "own", "score", "files", "above", "license"]
    )
    got = sorted(
        (
            (r["doc_id"], r["license"], r["origin"]) for r in licenses.license_scan(
                df, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
            ).collect()
        ),
        key=str
    )
    assert got == sorted([(1, "MIT", "file"), (2, "CC-BY-4.0", "header"), (None, None, None), (None, None, None)], key=str)
    assert licenses.license_scan(df.limit(0), F.lit("x")).count() == 0


def test_license_cosine_matches_dense_vectors():
    m = licenses.Matcher()
    vocabulary = sorted(m.idf)
    for text in [
        "Licensed under the Apache License", "released under the mit license . mit", "all rights reserved by nobody",
        "use of this source code"
    ]:
        own = Counter(licenses.tokens(text))
        dense = np.array([own[w] * m.idf[w] for w in vocabulary])
        outside = sum((n * m.top) ** 2 for w, n in own.items() if w not in m.idf)
        scores = []
        for name, ws in m.notices:
            t = np.array([Counter(ws)[w] * m.idf[w] for w in vocabulary])
            scores.append((round(float(t @ dense / np.linalg.norm(t) / np.sqrt(dense @ dense + outside)), 9), name))
        top = max(s for s, _ in scores)
        name, score = m.best(own)
        assert abs(score - top) < 1e-6 and (top, name) in scores


def test_urls_of_odd_tables(spark):
    rules, listed = queries.url_rows(spark, queries.RULES), queries.url_rows(spark, queries.LISTED)
    urls = [
        "http://h.com/", "http://h.com/", None, "http://" + "a." * 50_000 + "spam-farm.example.org/x", "http://" + "b" * 100_000,
        "x://net" + "/fr/" * 20_000
    ]
    names = ["host", "key", "verdict", "rule", "host_len", "_hits", "listed"]
    df = spark.createDataFrame(
        [(i // 2, u, *["k"] * len(names)) for i, u in enumerate(urls)],
        "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names)
    )
    got = Counter(
        (r["page_id"], r["rule"], r["verdict"], r["listed"]) for r in url_filter.url_filter(df, rules, listed).collect()
    )
    assert got == Counter(
        [(0, "com/", "allow", None)] * 2 + [
            (1, None, "allow", None), (1, None, "block", "spam-farm.example.org/"), (2, None, "allow", None),
            (2, "net/fr/", "block", None)
        ]
    )
    assert url_filter.url_filter(df.limit(0), rules, listed).count() == 0
    assert {
        r["verdict"] for r in url_filter.url_filter(df, rules.limit(0), listed.limit(0)).collect()
    } == {"allow"} == {r["verdict"] for r in url_filter.url_filter(df, rules.limit(0)).collect()}
    ties = queries.url_rows(spark, [("h.com", "/", "block"), ("h.com", "/", "allow"), ("com", "/", "block")])
    assert {
        (r["rule"], r["verdict"]) for r in url_filter.url_filter(df.where("page_id = 0"), ties).collect()
    } == {("h.com/", "allow")}
    # with a full filter, and without a broadcast, the answers are the same
    many = queries.url_rows(spark, [*queries.LISTED, *[(f"h{i}.org", "/", "block") for i in range(300)]])
    seen = lambda **given: Counter(
        (r["page_id"], r["rule"], r["verdict"], r["listed"]) for r in url_filter.url_filter(df, rules, many, **given).collect()
    )
    assert seen() == seen(broadcast_rows=0) == got


def test_packing_of_odd_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path(queries.TOKENIZER)
    df = with_clashes(
        spark, [(1, "a b"), (1, "a b"), (None, None), (None, "c"), (2, words(4000, 5))],
        ["piece", "start", "length", "sequence_id", "_item", "ids"]
    )
    rows = packing.pack_documents(df, path).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in rows if r["doc_id"] != 2) == Counter([(1, 0)] * 2 + [(None, 0)] * 2)
    own = sorted((r for r in rows if r["doc_id"] == 2), key=lambda r: r["piece"])
    assert all(
        r["length"] == 1024 for r in own[1:]
    ) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_distance_matches_brute_force():
    """Out-of-place distances by their definition, over dictionaries."""
    texts = {
        "en": "the river and the light of the stone", "de": "der fluss und das licht auf dem stein",
        "fr": "la pierre et la lumière de la rivière"
    }
    ranked = {n: language.profile(t).tolist() for n, t in texts.items()}
    profiles = language.Profiles(ranked)
    for text in [*texts.values(), "stone und pierre", "licht", "x"]:
        own = language.profile(text).tolist()
        distance = {
            n: sum(min(abs(r.index(c) - i), language.SIZE) if c in r else language.SIZE for i, c in enumerate(own)) for n, r in ranked.items()
        }
        best = min(sorted(distance), key=distance.get)
        name, score = profiles.predict(text)
        assert name == best and abs(score - (1 - distance[best] / (language.SIZE * len(own)))) < 1e-12


def test_language_of_odd_tables(spark):
    rows = [
        (i, ("the light " if i % 2 else "das licht ") * 5, "en" if i % 2 else "de", "x") for i in range(40)
    ] + [(1, "the light", "en", "x")] * 2 + [(None, "das licht", "de", "x"), (None, None, None, "x"), (7, "the " * 100_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.language_id(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and {
        r["lang_pred"] for r in got if r["doc_id"] == 1
    } == {"en"}
    assert language.language_id(df.limit(0)).count() == 0
    tie = language.Profiles({"b": [1, 2], "a": [1, 2]})
    assert tie.names == ["a", "b"] and int(np.argmin([3, 3])) == 0


def test_quality_classifier_of_odd_tables(spark, docs):
    rows = [
        (i, words(150, i) if i % 2 else words(150, i).upper()) for i in range(60)
    ] + [(1, words(150, 1))] * 3 + [(None, "x"), (None, None), (2, words(60_000, 3).upper())]
    df = with_clashes(spark, rows, ["score", "predicted", "held_out", "_y", "t", "h"])
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int"
    )
    got = quality_mil.quality(df, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and len(
        {r["score"] for r in got if r["doc_id"] == 1}
    ) == 1
    assert quality_mil.quality(df.limit(0), labels).count() == 0
    with pytest.raises(ValueError, match="score"):
        quality_mil.quality(df, labels, carry=["score"])


def test_classifier_trains_on_whole_documents(spark):
    """What earns the label may be in any one passage of a long text."""
    r, rows, labels = random.Random(3), [], []
    for i in range(160):
        parts = [words(100, 1000 + 40 * i + j) for j in range(30)]
        if i % 2:
            parts[r.randrange(30)] = "#!# $$$ " * 130
        rows.append((i, " ".join(parts)))
        labels.append((i, i % 2, 0))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )
    got = quality_mil.quality(df, known, threshold=0.5).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["held_out"]]) > 0.9


def test_scores_match_the_formula():
    """The gated attention of one bag, written out."""
    model = quality_mil.AttentionMIL()
    model.p["w"] = np.random.default_rng(2).normal(0, 1, len(model.p["w"]))
    x = np.concatenate([x for _, x in quality_mil.encoded([words(900, 4)])]).astype(np.float64)
    h = [np.tanh(v @ model.p["W"] + model.p["b"]) for v in x]
    e = [np.exp(model.p["w"] @ (np.tanh(v @ model.p["V"]) / (1 + np.exp(-(v @ model.p["U"]))))) for v in h]
    z = sum(a * v for a, v in zip(e, h)) / sum(e)
    assert np.allclose(model.score([words(900, 4)]), 1 / (1 + np.exp(-(z @ model.p["c"] + model.p["d"][0]))))


def test_rates_match_dense_least_squares(spark):
    """The rates nearest to 1, nonnegative, that meet the targets: against a dense projected descent."""
    r = np.random.default_rng(8)
    p, n = r.dirichlet((2, 1, 1), 60), r.integers(20, 200, 60).astype(float)
    soft = spark.createDataFrame([(int(a), [float(y) for y in x]) for a, x in zip(n, p)], "n_tokens long, p array<double>")
    g, targets, _ = mixing.solve(soft, [0.6, 0.3, 0.1], within=1e-9)
    rates = np.clip(1 - p @ np.array(g), 0, mixing.MOST)
    a = (p * n[:, None]).T  # totals are a @ rates
    x, scale = np.ones(60), 1 / n.max()
    dual = np.zeros(3)
    for _ in range(200_000):  # dual ascent on sum n (x - 1)^2 / 2 with a x = targets, x >= 0
        x = np.clip(1 - p @ dual, 0, mixing.MOST)
        dual += scale / 60 * (a @ x - targets)
    assert np.allclose(a @ x, targets, rtol=1e-5) and np.allclose(rates, x, atol=1e-3)


def test_mixing_of_odd_tables(spark):
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(20)], "doc_id long, domain string")
    rows = [
        (i, words(100, i) + (" foul" * 30 if i % 2 == 0 else "")) for i in range(20)
    ] + [(1, words(100, 1))] * 3 + [(None, "x y"), (None, None), (30, words(40_000, 5))]
    df = with_clashes(spark, rows, ["bucket", "_words", "n_tokens", "p", "rate", "copies", "domain", "_a"])
    got = mixing.mix(df, labels, {"clean": 0.8, "toxic": 0.2}, repeat=4.0).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({(r["rate"], r["copies"]) for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(df.limit(0), labels).count() == 0


def write_labels(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_loses_no_text_but_by_its_rules(spark, docs, tmp_path):
    """Repeated rows, null ids, empty and very long texts through the whole pipeline: of each distinct good
    text one copy survives, whole."""
    import corpus_pipeline

    good = [words(120, i) for i in range(60)]
    bad = [words(120, 200 + i).upper().replace(" ", " ### ") for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(0, good[0])] * 2 + [
        (None, good[1]), (None, words(120, 500)), (None, words(120, 500)), (900, words(8000, 501)), (901, words(120, 502)),
        (902, words(120, 502) + " tail"), (903, "")
    ]
    df = docs(*[t for _, t in rows], ids=[i for i, _ in rows])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    write_labels(spark, tmp_path, [(i, int(i < 60), 0) for i in range(120)])
    stage = df
    for name, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == corpus_pipeline.COLUMNS, name
    texts = Counter(r["text"] for r in stage.collect())
    for t in [*good, words(120, 500), words(8000, 501), words(120, 502)]:
        assert texts[t] == 1
    assert not set(bad) & set(texts) and words(120, 502) + " tail" not in texts
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["doc_id"] is not None and r["piece"] == 0)[0] == 1
    assert sum(
        r["doc_id"] is None and r["piece"] == 0 for r in packed
    ) == 1 and any(r["doc_id"] == 900 and r["piece"] > 0 for r in packed)


def test_pipeline_of_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    write_labels(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_deletes_what_it_stored(spark, docs, tmp_path):
    import corpus_pipeline
    from quire.llm import common

    docs(*[words(100, i) for i in range(20)]).write.parquet(f"{tmp_path}/documents.parquet")
    write_labels(spark, tmp_path, [(i, i % 2, 0) for i in range(20)])
    before = set(common._written)
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(common._written) - before) == 1


def test_near_duplicates_of_the_corpus_table(spark):
    """All pairs of the smallest table by brute force: no link between different texts is lost, none invented."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(table).collect()}
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    bags = {i: np.unique(near_dup.shingles(t), return_counts=True) for i, t in texts.items()}
    group = {i: i for i in texts}
    ids = sorted(texts)
    links = 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if texts[a] == texts[b] or near_dup.similarity(bags[a], bags[b]) >= 0.8:
                links += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert links > 0 and got == group


def test_base_counts_match_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.quality_rules(spark.read.parquet(path)).collect())
    want = duckdb.sql(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM read_parquet('{path}')),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM again GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
SELECT doc_id, len(w), length(array_to_string(w, '')), length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), len(l) - len(list_distinct(l)), coalesce(r.n, 0), len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w)
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""").fetchall()
    assert got == sorted(want)


def test_hot_keys_meet_a_broadcast(spark):
    """A vector, a class and a folder that hold a third of all rows are in no single task's join."""
    from quire.llm.common import hot_keys, join_counted

    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_keys(right, "n") == [0]
    joined = join_counted(left, right, ["k"], "n")
    assert joined.count() == 9000 and joined.where("k = 0 and n <> 3000").count() == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert join_counted(left.limit(0), right.limit(0), ["k"], "n").count() == 0
