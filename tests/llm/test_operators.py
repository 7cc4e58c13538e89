import math
import re
import zlib
from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracketry.llm import context_mixing, decontamination, jaccard_join, license_scan, packing, quality_crf, quality_rules, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}x" for k in range(400)]


def some_docs():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, int(n))) for n in rng.integers(60, 200, 40)]
    texts += [texts[0], texts[1] + " more", texts[2].replace("w1x", "w2x"), "", None, " \n\t ", "one two", "One  two", "x" * 5000, "line one here\n" * 30, texts[3][:300] + "\n" + texts[3]]
    return [(k, t, "en", "src0" if k % 3 else None, None) for k, t in enumerate(texts)] + [(0, texts[0], "en", None, None), (None, "no id at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOC).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_packing_round_trip(spark, docs):
    ids = packing.Ids(packing.tokenizer_path())
    whole = {(k, t): np.frombuffer(packing.encode(t or "", ids), "<u4").tolist() + [0] for k, t, *_ in some_docs()}
    rows = packing.pack(docs, capacity=256).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    want = Counter((k, p, s, n, zlib.crc32(np.array(v[s : s + n], "<u4").tobytes())) for k, t, *_ in some_docs() for v in [whole[k, t]] for p, (s, n) in enumerate(packing.cut(len(v), 256)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    ids = packing.Ids(packing.tokenizer_path())
    for s in ["", " ", "a  b\n\n c\t\td  ", "it's  'll we've", "\x1ca\x1d b\x85c", "12 3４5 ²x", "<|endoftext|>", "é…! ok,", " 　q a_b", *(x[1] for x in some_docs() if x[1])]:
        assert packing.encode(s, ids) == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_uses_every_item_once():
    rng = np.random.default_rng(0)
    for cap in (10, 50, 2048):
        for _ in range(60):
            h = {int(n): int(c) for n, c in zip(rng.integers(1, cap + 1, 30), rng.integers(1, 20, 30), strict=True)}
            seen, bins = {}, {}
            for n, rank, first, over, each, offset in packing.plan(h, cap):
                for j in range(over * each):
                    seen.setdefault(n, set()).add(rank + j)
                    bins.setdefault(first + j // each, []).append((offset + j % each * n, n))
            assert {n: sorted(s) for n, s in seen.items()} == {n: list(range(c)) for n, c in h.items()}
            for b in bins.values():
                assert all(o + n <= p for (o, n), (p, _) in pairwise(sorted(b))) and max(o + n for o, n in b) <= cap
                assert sum(3 * n > cap for _, n in b) <= 2


def test_rule_counts(spark, docs):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(docs).collect()}
    for k, t, *_ in some_docs():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)) in got
    assert quality_rules.judge(docs).count() == len(some_docs())


def test_url_rules(spark):
    urls = [(1, "http://A.example.COM/en/x"), (2, "https://www.example.com/en/"), (3, "ftp://x.net/es/a?b"), (4, "nothing"), (5, None), (6, "http://example.com"), (7, "http://com.org/en/"), (8, "http://notexample.com/en/#y"), (1, "http://A.example.COM/en/x")]
    df = spark.createDataFrame([(*u, "mine") for u in urls], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.PAGE_RULES, "verdict string, host string, path string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect() if r["rule"])
    assert got == [(1, "a.example.com", "/en/x", "example.com/en/", "block")] * 2 + [(2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "x.net", "/es/a", "net/es/", "block"), (8, "notexample.com", "/en/", "com/", "allow")]
    assert url_filter.judge(df, rules).count() == len(urls) and url_filter.judge(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_decontamination(spark, docs, none):
    text = some_docs()[5][1]
    bench = spark.createDataFrame([(1, " ".join(text.split()[20:40])), (2, "one two"), (3, ""), (4, None), (10, "never seen anywhere")], "item_id long, text string")
    got = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontamination.mark(docs.withColumn("items", F.lit(1)), bench).collect()}
    assert (5, 20, ("1",)) in got and (46, 2, ("2",)) in got and (47, 2, ("2",)) in got and (43, 0, ()) in got
    left = decontamination.remove_documents(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()}.isdisjoint({5, 46, 47}) and left.count() == len(some_docs()) - 3
    assert decontamination.remove_spans(docs, bench).where("doc_id = 5").first()["text"].split() == text.split()[:20] + text.split()[40:]
    assert decontamination.mark(none, bench).count() == 0 and decontamination.mark(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_groups(rows):
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").lower().split()
        if k is not None:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize("hot", [3, jaccard_join.HOT])
def test_jaccard_groups(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = np.random.default_rng(5)
    rows = list(some_docs())
    base = list(rng.choice(WORDS, 120))
    for k in range(60):  # near copies around the threshold
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[j] = f"new{rng.integers(50)}"
        rows.append((100 + k, " ".join(w), None, None, None))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got.pop(None)[1] is None and got == brute_groups(rows)
    assert jaccard_join.groups(none).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and 40 not in {r["doc_id"] for r in kept.collect()}


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.0\r\n" + "y" * 1200
    rows = [(1, "http://a b/", big), (2, None, big), (3, "http://c/", "small"), (4, "u", "small"), (5, "u", None), (2, None, big), (None, "u", big)]
    got = sorted(((r["key"] or "", r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    n = len(big.encode())
    assert got == sorted([("1", n, "revisit", "2"), ("2", n, "response", None), ("2", n, "response", None), ("3", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), ("", n, "revisit", "2")], key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions():
    a = warc.parse_arc(b"filedesc://x 0.0.0.0 19990101000000 text/plain 4\n1 0\n\n" + warc.arc_record(1, "http://a/", "1.2.3.4", "1999", "text/html", b"b\n\nc"))
    b = warc.parse_arc(warc.arc_record(2, "http://a/", "1.2.3.4", "19991231235959", "text/html", b""))
    assert [(r["version"], r["body"], r["url"]) for r in a + b] == [(1, b"b\n\nc", "http://a/"), (2, b"", "http://a/")]
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z" and warc.warc_date("bad") == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://a/ 1.2.3.4 1999 text/html 99\nshort")


def brute_licenses(text):
    own = license_scan.shingle_row(license_scan.tokens(text.encode()))
    return {n for n, t in license_scan.TEMPLATES for s in [set(license_scan.shingle_row(license_scan.tokens(t.encode())).tolist())] if len(s & set(own.tolist())) >= 0.8 * len(s)}


def test_license_scan(spark):
    pad = " ".join(WORDS[:300])
    texts = [f"{pad} {t} {pad}" for _, t in license_scan.TEMPLATES] + [pad, "", None, license_scan.TEMPLATES[7][1].replace("copies", "clones")]
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: brute_licenses(t or "") for k, t in enumerate(texts)}


def test_crf_against_enumeration():
    rng = np.random.default_rng(2)
    unary, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    counts, starts = np.array([4, 1, 2]), np.array([0, 4, 5])
    good, _, log_z = quality_crf.marginals(unary, trans, starts, counts)
    for s, n, lz in zip(starts, counts, log_z, strict=True):
        paths = [[m >> i & 1 for i in range(n)] for m in range(2**n)]
        w = np.exp([sum(unary[s + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in pairwise(p)) for p in paths])
        assert abs(np.log(w.sum()) - lz) < 1e-9
        for i in range(n):
            assert abs(sum(w[k] for k, p in enumerate(paths) if p[i]) / w.sum() - good[s + i]) < 1e-9


def labelled(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        w = list(rng.choice(WORDS, 40))
        bad, toxic = k % 4 == 0, k % 5 == 0
        if toxic:
            w[int(rng.integers(40))] = "vileword"
        rows.append((k, " ".join(x + ("###" if bad else "") for x in w[:20]) + ".\n" + " ".join(x + ("$$$" if bad else "") for x in w[20:]) + ".", int(not bad), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_quality_and_toxicity(spark, docs, none):
    own, labels = labelled(spark)
    got = {r["doc_id"]: r["score"] for r in quality_crf.apply(own, quality_crf.train(own, labels)).collect()}
    assert all((got[k] >= 0.3) == (k % 4 != 0) for k in got)
    model = toxicity.train(own, labels)
    clean = {r["doc_id"]: r for r in toxicity.apply(own, model).collect()}
    hits = [k for k, r in clean.items() if r["score"] >= 0.7]
    assert len([k for k in hits if k % 5]) == 0 and len(hits) > 50 and all(len(clean[k]["sentences"]) == 1 for k in hits)
    for keep, model_labels in ((quality_crf.keep_good, labels), (toxicity.keep_clean, labels), (quality_crf.keep_good, labels.limit(0)), (toxicity.keep_clean, labels.limit(0))):
        out = keep(docs, model_labels)
        assert out.columns == docs.columns and out.count() <= len(some_docs()) and keep(none, model_labels).count() == 0


def test_scores_count_every_token(spark, docs, none):
    rows = [(k, (t or "").encode().lower().split() + [None]) for k, t, *_ in some_docs()]
    train = [k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
    c = Counter(w for (_, ws), t in zip(rows, train, strict=True) if t for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((k, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in rows)
    got = context_mixing.score(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and context_mixing.score(none).count() == 0


def small_model(rows, bits=16):
    some = [context_mixing.tokens((t or "").encode()) for t in rows]
    c = Counter(w for ws in some for w in ws)
    stops = c.pop(b"\n")
    words = sorted((w for w, n in c.items() if n >= 3), key=lambda w: (-c[w], w))
    counts = np.array([c[w] for w in words])
    model = context_mixing.Tokens(words, counts, sum(c.values()) - int(counts.sum()), stops, bits)
    n, mixer, tally = context_mixing.Counts((bits,) * 3), context_mixing.Mixer(4), np.zeros(8)
    for at in range(0, len(some), 5):
        context_mixing.learn_stream(model, n, mixer, tally, model.stream(some[at : at + 5]))
    return some, words, counts, model, context_mixing.Tables([context_mixing.coded(x.reshape(-1, 2)) for x in n.n]), mixer, tally


def test_next_token_is_a_distribution():
    some, words, _, model, tables, mixer, tally = small_model([t for _, t, *_ in some_docs()])
    one = mixer.predict([np.zeros(1, np.float32)] * 4, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    assert 0 < one < 1
    for start in (some[0][:7], some[5][:-1], words[:1], []):
        p = 0.0
        for w in [*words, b"\n", b"never met"]:
            s = model.stream([[*start, w]])
            p += np.exp(context_mixing.score_stream(model, tables, mixer, np.zeros(8), s)[-1]) / (0.5 if len(s.told) and s.told[-1] and w == b"never met" else 1)
        assert abs(p - 1) < 1e-5


def test_texts_do_not_reach_into_each_other():
    some, _, _, model, tables, mixer, tally = small_model([t for _, t, *_ in some_docs()])
    s = model.stream(some)
    whole = np.bincount(s.text, context_mixing.score_stream(model, tables, mixer, tally, s))
    alone = [context_mixing.score_stream(model, tables, mixer, tally, model.stream([x])).sum() for x in some]
    assert np.allclose(whole, alone, rtol=1e-5)


def test_code_paths():
    rng = np.random.default_rng(4)
    for m in (2, 3, 50, 1000):
        counts = rng.integers(1, 10_000, m)
        code = context_mixing.Code(counts)
        assert abs((0.5**code.size).sum() - 1) < 1e-12 and set(code.node.tolist()) == set(range(m - 1))
        paths = {tuple(zip(code.node[s : s + n].tolist(), code.bit[s : s + n].tolist(), strict=True)) for s, n in zip(code.start, code.size, strict=True)}
        assert len(paths) == m and all(p[0][0] == 0 for p in paths)
        lines = set(zip(code.salt.tolist(), code.within.tolist(), strict=True))
        assert len(lines) == m - 1 and max(code.within) < 1 << context_mixing.GROUP
        mean = (counts * code.size).sum() / counts.sum()
        h = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
        assert h <= mean < h + 1


def test_spelling_against_single_decisions():
    words = [b"ab", b"abc", b"b", "é".encode(), b"abab" * 50]
    code = context_mixing.letters(words, np.arange(1, 6))
    n = context_mixing.Counts(context_mixing.SPELL_BITS)
    word, bit, slots, node = context_mixing.spelling(words, code)
    n.add(slots, bit)
    tables, mixer = context_mixing.Tables([context_mixing.coded(x.reshape(-1, 2)) for x in n.n]), context_mixing.Mixer(5)
    got = context_mixing.spelling_scores(tables, mixer, words, code)
    want = np.zeros(len(words))
    for k in range(len(bit)):
        x, (high, low) = tables.look([s[k : k + 1] for s in slots], (4, 2))
        p = mixer.predict(x, high.astype(np.int64) * 8 + low, node[k : k + 1])[0]
        want[word[k]] += math.log(p if bit[k] else 1 - p)
    assert np.allclose(got, want, rtol=1e-5)
    each = np.exp(context_mixing.spelling_scores(tables, mixer, [bytes([k]) for k in range(256) if k != 32], code))
    assert 0 < each.sum() < 1 and len(bit) == sum(code.size[c] for w in words for c in w + b" ")


def test_all_training_tokens_reach_the_weights(spark):
    rows = [(k, f"word{k} and " * (4000 if k == 3 else 5)) for k in range(12)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = [context_mixing.tokens(t.encode()) for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for ws in own for w in ws)
    model = context_mixing.Tokens([b"and"], np.array([c[b"and"]]), sum(c.values()) - c[b"and"] - len(own), len(own), 16)
    tables, mixer, _ = context_mixing._learned(context_mixing._training(df, 7, 2), spark.sparkContext.broadcast(model), (16,) * 3)
    decisions = sum(int(model.code.size[model.index.get(w, 0)]) for ws in own for w in ws)
    assert mixer.w_seen.sum() == decisions == round(mixer.maps_seen.sum())
    assert context_mixing.table_bits(3_600_000) > context_mixing.table_bits(400_000) > context_mixing.table_bits(1000)


def test_order_of_words_changes_the_score(spark):
    words = "one red fox ran over some low hill".split()
    said, turned = " ".join(words), " ".join(words[::-1])
    assert zlib.crc32(b"3") % 7 != 2
    df = spark.createDataFrame([(3, said)] * 20 + [(None, said), (None, turned)], "doc_id long, text string")
    got = [r["score"] for r in context_mixing.score(df).collect() if r["doc_id"] is None]
    assert len(got) == 2 and max(got) - min(got) > 5


def test_hashes_and_symbols_of_whole_texts():
    odd = [b"", b" ", b"One\x0btwo\x0cTHREE \r\n\tfour ", b"x" * 300 + b" " + b"x" * 301, b"a\x00 a \x00a a\x00\x00", b"\x1c\x85 \xc3\xa9\xc2\xa0b"]
    some = [*odd, *(b"y" * k + b" " + b"y" * k + b"Z" for k in range(70)), *((t or "").encode() for _, t, *_ in some_docs())]
    each = [context_mixing.tokens(t) for t in some]
    *_, h, n = context_mixing.joined(some)
    assert n.tolist() == [len(ws) - 1 for ws in each]
    flat = [w for ws in each for w in ws[:-1]]
    assert (h == context_mixing.hashes(flat)).all() and len(set(h.tolist())) == len(set(flat))
    words = sorted(set(flat))[::3] + [b"word%d" % k for k in range(5000)]
    model = context_mixing.Tokens(words, np.ones(len(words), np.int64), 1, 1, 16)
    got, want = model.read(some), model.stream(each)
    assert got.symbols.tolist() == want.symbols.tolist() == [model.index.get(w, context_mixing.ESCAPE) for ws in each for w in ws]
    assert (got.h == want.h).all() and (got.text == want.text).all()


def test_counts_of_16_bits_lose_nothing():
    model = context_mixing.Tokens([b"a"], np.array([200_000]), 1, 1, 16)
    wide, narrow = context_mixing.Counts((16,) * 3), context_mixing.Counts((16,) * 3, np.uint16)
    for n in (wide, narrow):
        mixer = context_mixing.Mixer(4)
        for _ in range(2):
            context_mixing.learn_stream(model, n, mixer, np.zeros(8), model.read([b"a " * 200_000, b"b"]))
        assert all(n.whole(k).sum() == mixer.w_seen.sum() for k in range(3))
    assert all((wide.n[k] == narrow.whole(k)).all() for k in range(3)) and max(x.max() for x in wide.n) > 1 << 17


def test_few_repeated_lines_of_many_pass(spark):
    lines = [f"line {k} has words of its own" for k in range(400)]
    rows = [(1, "\n".join([*lines, *lines[:3]])), (2, "\n".join(lines[:3] * 4)), (3, "\n".join(lines[:3]))]
    df = spark.createDataFrame([(k, "h", t) for k, t in rows], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_failed"]) for r in quality_rules.with_rules(quality_rules.measure(df, "source")).collect()}
    assert got == {1: (3, 0), 2: (9, 1), 3: (0, 0)}


def test_windows_of_more_words_than_a_key_holds():
    ids = quality_rules._Words()
    words = [f"a{k}".encode() for k in range(1 << 21)] + [b"x", b"y", b"z", b"q"]
    assert quality_rules.repeat_words(words, ids) == 0
    assert quality_rules.repeat_words([*words, b"x", b"y", b"z"], ids) == 6


def test_long_texts_of_lines_stay_small():
    n = 20_000
    rng = np.random.default_rng(1)
    counts = np.array([n, *[1] * 300])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    unary, trans = rng.normal(size=(counts.sum(), 2)), rng.normal(size=(2, 2))
    good, _, log_z = quality_crf.marginals(unary, trans, starts, counts)
    one, _, z = quality_crf.marginals(unary[:n], trans, starts[:1], counts[:1])
    assert np.allclose(good[:n], one) and np.isclose(log_z[0], z[0])
    assert np.allclose(good[n:], 1 / (1 + np.exp(unary[n:, 0] - unary[n:, 1])))


def test_length_alone_is_not_toxic():
    model = {"words": {b"vile": 3.0}, "bias": -4.0}
    clean, weak = b"some words here. and others.\n" * 50_000, b"a vile thing.\n"
    assert toxicity.document_score(model, clean) == 0
    assert toxicity.document_score(model, weak * 1000) == toxicity.document_score(model, weak) < 0.5
    assert toxicity.document_score(model, b"") == 0


@pytest.mark.parametrize("near", [1_000_000, 0])
def test_decontamination_both_sides_of_the_switch(spark, docs, near, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", near)
    rows = [(1, " ".join(some_docs()[5][1].split()[20:40])), (2, "one two"), (7, " ".join(some_docs()[6][1].split()[:15]))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontamination.mark(docs, bench).collect())
    want = Counter()
    for k, t, *_ in some_docs():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        hit, items = set(), set()
        for i, b in rows:
            b = b.split()
            m = min(10, len(b))
            grams = {tuple(b[j : j + m]) for j in range(len(b) - m + 1)}
            at = [j for j in range(len(w) - m + 1) if tuple(w[j : j + m]) in grams]
            hit |= {p for j in at for p in range(j, j + m)}
            items |= {str(i)} if at else set()
        want[k, len(hit), tuple(sorted(items))] += 1
    assert got == want


def test_licenses_back_to_back():
    index = license_scan.Index(license_scan.TEMPLATES)
    k = next(k for k, (n, _) in enumerate(license_scan.TEMPLATES) if n == "BSD")
    text = license_scan.TEMPLATES[k][1]
    m = len(license_scan.shingle_row(license_scan.tokens(text.encode())))
    for times in (1, 2, 4):
        pad = " ".join(WORDS[:60])
        found = [r for r in index.find((pad + " " + (text + " ") * times + pad).encode()) if r["template"] == k]
        own = m + 4
        assert [(r["start"], r["end"]) for r in found] == [(60 + j * own, 60 + j * own + m) for j in range(times)]


def test_revisits_name_the_record(spark):
    big = "y" * 1200
    rows = [(1, "http://a b/", big), (9, "http://z/", big)]
    made = warc.convert(warc.arcs(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")))).collect()
    heads = [next(warc.parse_warc(bytes(r["warc"])))["head"] for r in made]
    ids = {h["X-Key"]: h["WARC-Record-ID"] for h in heads}
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    assert revisit["WARC-Refers-To"] == ids["9"] and revisit["WARC-Refers-To-Target-URI"] == "http://z/"
