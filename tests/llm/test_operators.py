"""Each operator against brute force or known answers, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import html
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlog.llm import graph_ann, html_text, langid, mixing, packing, quality, secrets, simhash, toxicity, wordpiece
from strandlog.llm.common import fold, scratch, shared_dir, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, size string"
EN, DE = "the and that with from have this there were they".split(), "und der die das nicht ein mit auf für sich".split()


def prose(draw, words, n):
    return " ".join(draw.choices(words, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, DE if i % 2 else EN, draw.randint(1, 60)), "de" if i % 2 else "en", f"s{i % 3}") for i in range(80)]
    copy = prose(draw, EN, 50)
    rows += [(100 + i, copy, "en", "s0") for i in range(30)]
    rows += [(200, None, "en", "s1"), (201, "", "en", None), (202, "  \n\t ", None, "s2"), (203, "123 !!", "en", None), (None, "the and that", None, "s1"), (204, "é😀 日本 the\x00x", "de", "s1"), (205, "the " * 20000, "en", "s2"), (0, rows[0][1], rows[0][2], rows[0][3])]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_scratch_tables_go(spark, docs, tmp_path):
    """What a block makes is deleted at its end but for what it keeps; results that were kept can still be read."""
    import os

    def tables():
        return {x for x in os.listdir(shared_dir(spark)) if x.startswith("strandlog-")}

    before = tables()
    with scratch() as keep:
        one = keep(written(docs.select("doc_id")))
        with scratch() as inner:
            written(docs)
            two = inner(written(docs.select("text")))
        assert len(tables() - before) == 2 and two.count() == docs.count()
    assert len(tables() - before) == 1 and one.count() == docs.count()
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = tables()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() > 0 and len(tables() - before) <= 4  # the last stage's own, which its rows are read from


def test_fold(spark):
    got = spark.createDataFrame([(i,) for i in range(200)], "i long").select(fold(F.col("i"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 4 for i in range(200)]


def test_simhash_as_brute_force(docs, none):
    got = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        own = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
        prints[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    ids, up = sorted(prints), {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", root(i)) for i in ids}
    assert len(got) == docs.where("doc_id is not null").count()
    assert simhash.near_duplicates(none).count() == 0


def test_every_pair_within_the_radius_meets():
    kept, draw = simhash.masks(4), random.Random(1)
    for _ in range(3000):
        gap = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4)))
        assert any(gap & m == 0 for m in kept)
        for m, more in zip(kept, simhash.finer(4), strict=True):
            assert all(m & x == 0 for x in more) and (gap & m or any(gap & x == 0 for x in more))


def test_links_in_blocks(spark):
    draw = random.Random(2)
    base = draw.getrandbits(63)
    values = {base} | {base ^ (1 << draw.randrange(60)) ^ (1 << draw.randrange(60)) for _ in range(300)} | {draw.getrandbits(63) for _ in range(100)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for block, hot in ((16, 10**9), (4096, 10**9), (16, 20), (4096, 2)):
        got = {r.node: r.label for r in simhash.components(simhash.links(df, 4, block, hot)).collect()}
        near = simhash.near_edges(np.array(sorted(values), np.uint64), 4)
        assert len(near[0]) == sum(1 for _ in got) - len(set(got.values()))
        assert all(got[int(a)] == got[int(b)] for a, b in zip(*near, strict=True))


def test_stages_take_any_column_name(spark, docs, tmp_path):
    """Names with dots and quotes, and names that the stages use themselves."""
    import corpus_pipeline

    odd = docs.withColumn("a.b", F.lit(1)).withColumn("x`y", F.lit("q")).withColumn("_sign", F.lit(2)).withColumn("_row", F.lit(3)).withColumn("_key", F.lit(4)).withColumn("copies", F.lit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert out.where("_sign = 2 and _row = 3 and _key = 4 and copies = 5").count() == out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() >= odd.count()


def test_dedup_keeps_one_of_each(docs, none):
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id between 100 and 129").count() == 1 and out.where("doc_id = 0").count() == 1 and out.where("doc_id is null").count() == 1
    assert simhash.deduplicated(none).count() == 0


def test_mixing(docs, none):
    sizes = mixing.sized(docs, ["doc_id", "source"])
    rows = mixing.mixed_counts(mixing.written(sizes)).collect()
    again = mixing.mixed_counts(mixing.written(sizes)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    own = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(n for n, _ in own.values()) * 1.5 == pytest.approx(sum(t for _, t in own.values()))
    for s, (n, target) in own.items():
        assert target <= 2 * n and all(r.copies <= 2 for r in rows)
        taken = sum(r.size * r.copies for r in rows if r.source == s)
        assert abs(taken - target) <= 2 * max(r.size for r in rows if r.source == s)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixture(none).count() == 0


def test_filled():
    assert mixing.filled([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])  # 3 : 1 : 2 of 450, the first stops at 200
    assert sum(mixing.filled([10, 1000, 5, 0])) == pytest.approx(1.5 * 1015)
    assert mixing.filled([]) == [] and mixing.filled([0, 0]) == [0, 0]


def test_encoder_as_the_library():
    from tokenizers import Tokenizer

    plain, draw = Tokenizer.from_file(packing.vocabulary()), random.Random(4)
    parts = ["a", "word", " ", "  ", "\n", ".", ",", "'s", "'", "12", "é", "$$$", "\t", "<|endoftext|>", "日本", "’", "　", "\x85"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 20))) for _ in range(3000)]
    for text, got in zip(texts, packing.Encoder(packing.vocabulary()).ids(texts), strict=True):
        assert got == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing(docs, none):
    rows = packing.pack(docs, capacity=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.03 * total / 64 + 1
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert [x for x in sorted(by[205])][1][2] == 64 and by[200] == [(0, 0, 1)]
    assert packing.pack(none).count() == 0


def test_patterns_hold_every_capacity():
    counts = {1: 500, 7: 90, 30: 44, 64: 3, 40: 21}
    for score in ("norm", "dot"):
        found = packing.patterns(counts, 64, most_pieces=9, most_cost=64.0**2, score=score)
        got = {}
        for bins, held in found:
            assert sum(n * k for n, k in held) <= 64 and sum(k for _, k in held) <= 9 and sum(n * n * k for n, k in held) <= 64**2
            for n, k in held:
                got[n] = got.get(n, 0) + bins * k
        assert got == counts
    tiny = packing.patterns({1: 10_000, 2048: 3})
    assert max(sum(k for _, k in h) for _, h in tiny) <= 2 * 1250 and sum(n for n, _ in tiny) <= 3 + 10_000 // 1250 + 1
    assert {h for _, held in packing.patterns({5: 100, 1000: 100}) for h in held} and all(sum(k for _, k in h) <= 64 for _, h in packing.patterns({5: 100, 1000: 100}))


def test_ranked_encoder_only_where_it_fits(tmp_path):
    """A file in another order of ids, or of another kind, is left to the library."""
    with open(packing.vocabulary(), encoding="utf-8") as f:
        said = json.load(f)
    assert packing._ranked(said, {"<|endoftext|>"}) is not None
    swap = dict(said["model"]["vocab"])
    a, b = "".join(said["model"]["merges"][0]).replace(" ", ""), "".join(said["model"]["merges"][1]).replace(" ", "")
    swap[a], swap[b] = swap[b], swap[a]
    assert packing._ranked(said | {"model": said["model"] | {"vocab": swap}}, {"<|endoftext|>"}) is None
    assert packing._ranked(said | {"normalizer": {"type": "Lowercase"}}, {"<|endoftext|>"}) is None
    at = tmp_path / "own.json"
    at.write_text(json.dumps(said | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    own = packing.Encoder(str(at))
    assert own.one("Some WORDS") == own.one("some words") == packing.Encoder(packing.vocabulary()).one("some words")
    long = "x" + " " * 60_000 + "y\n" * 40_000
    plain = packing.Encoder(packing.vocabulary())
    assert plain.one(long) == np.array(plain.tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_language(docs, none):
    model = langid.learned(docs)
    rows = langid.identified(docs.select("doc_id", "lang", "text"), model).collect()
    assert len(rows) == docs.count()
    said = {r.doc_id: r for r in rows}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (200, 201, 202, 203))
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 80]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own) and all(0 <= r.score <= 1 for r in rows)
    assert langid.accepted(docs).columns == docs.columns
    assert langid.learned(none).langs == [] and langid.accepted(none).count() == 0
    long = "the and that " * 40000
    assert model.predict(long)[0] == "en"


def test_secrets(spark, docs, none):
    key = "Zk3xQ9vLr7WmT2bNc8YpHs4D"
    text = f'password = "hunter2hunter2" é API-KEY:x apikey: abc token=short12 AKIA{"Q7" * 8} ' + "0af" * 12 + f" {key} the_value_of_user_name_index_2"
    model = secrets.fitted(secrets.samples())
    base, every = secrets.scan(text, model.ratio, model.least)
    plain = []
    for k, (_, pattern, group, least) in enumerate(secrets.KINDS):
        plain += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    assert base == sorted(plain) and [k for _, k, _ in base] == [0, 1, 2]
    assert [text[a:b] for a, k, b in every if k == 3] == [key]
    corpus = [f"{a}{b}{c}" for a in ("ver", "chpf", "ant", "be") for b in ("heit", "schw", "wort", "un") for c in ("en", "ung", "sein", "tum")]
    fresh = secrets.samples(corpus, 500, seed=77)
    for own in (model, secrets.fitted(secrets.samples(corpus))):
        assert own.recall > 0.98 and own.precision > 0.98
    said = [(bool(secrets.scan(t, own.ratio, own.least)[1]), bool(y)) for t, y in fresh if len(t) >= 20]
    assert np.mean([x for x, y in said if y]) > 0.97 and np.mean([x for x, y in said if not y]) < 0.01
    found = lambda t: [t[a:b] for a, k, b in secrets.scan(t, own.ratio, own.least)[1] if k == 3]
    assert found("QwhZkTnbXvPlRsJdYfGcMoEa") == ["QwhZkTnbXvPlRsJdYfGcMoEa"]  # letters only
    assert not any(map(found, ("chpfheitschwheitenverheiten", "antwortungsbeheitsein2024", "kubernetes-deployment-prod-7", "2024-01-15-quarterly-report-final", "-" * 60, "a" * 60, "1234567890" * 5)))
    assert secrets.corpus_words(docs)[:3] == sorted({w for w in EN + DE}, key=lambda w: (-sum(w in re.findall("[A-Za-z]{2,40}", r.text or "") for r in docs.collect()), w))[:3]
    assert secrets.corpus_words(none) == []
    row = secrets.found(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest() and row[0].n_random == 1
    assert row[1].spans == "" and row[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and secrets.redacted(none).count() == 0
    assert secrets.covered("abcdef", [(1, 0, 3), (2, 2, 4)], "#") == "a#ef"[:2] + "ef"


def test_quality(spark, docs, none):
    draw = random.Random(5)
    rows = [(i, prose(draw, EN + DE, 80) if i % 3 else " ".join(x + "###" for x in draw.choices(EN + DE, k=80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    got = quality.judged(df, quality.train(df, labels)).collect()
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in got if not r.base_failed]) > 0.97
    words = b"a b c d e x a b c d e".split()
    assert quality.repeated_words(words) == 10 and quality.repeated_words([b"a"] * 7) == 7 and quality.repeated_words([]) == 0
    assert quality.repeated_lines(b"x\n\nx\n y\n\ny\n y") == 2
    assert quality.counted("é# b\n".encode(), "é# b\n".encode().split()) == (2, 3, 1, 0, 0)
    free = quality.train(none.select("doc_id", "text"), labels)
    rows = {r.doc_id: r for r in quality.judged(docs, free).collect()}
    assert rows[200].base_failed and not rows[200].kept and rows[200].n_words == 0 and rows[205].n_repeat_words == 20000
    assert quality.judged(none, free).count() == 0


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by the words of the rules."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def plain_grams(text, n, bits):
    for i in range(len(text) - n + 1):
        h = n * 0x9E3779B9
        for c in text[i : i + n]:
            h = (h * 0x100000001B3 + ord(c)) & (1 << 64) - 1
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
        yield (h ^ h >> 29) >> 64 - bits


def test_quality_as_brute_force(spark, docs):
    """Counts by the rules' words, probabilities feature by feature; nulls, empty and long texts, ties, repeated rows and texts, clashing columns."""
    draw = random.Random(15)
    odd = ["", None, " \n\x0b ", "a\nb\na\n\n\nb", "x y z x y z x y z x y z", "é# b\n日本 $$\n", "w " * 900, "a\u00a0b c\x85d\u2028e " * 3]
    odd += ["".join(draw.choices(["a", "b", " ", "\n", "#", "é", "a b c d e ", "\t"], k=draw.randint(0, 90))) for _ in range(60)]
    rows = [(i, t, str(i % 2), True) for i, t in enumerate([*odd, *odd])] + [(3, odd[3], "0", False), (None, "no id", "0", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, base_failed boolean").repartition(4)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(len(rows))] + [(1, 0), (2, None), (5, 7)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = quality.judged(df, model).collect()
    assert sorted(map(str, got)) == sorted(map(str, quality.judged(df.repartition(9), quality.train(df.repartition(7), labels)).collect()))
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        own = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, repr(text)
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        said = model.bias
        for slots_, weights in ((collections.Counter(zlib.crc32(w.encode()) & 2**14 - 1 for w in re.findall(r"[^\x20\x09-\x0D]+", text)), model.words), (collections.Counter(g for n in (2, 3) for g in plain_grams(text, n, 13)), model.grams)):
            total = sum(slots_.values())
            said += sum(math.sqrt(n / total) * weights[k] for k, n in slots_.items())
        p = 1 / (1 + math.exp(-max(-35, min(35, model.scale[0] * said + model.scale[1]))))
        assert abs(r.p_good - p) < 1e-9 and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_toxicity_as_brute_force(spark, docs):
    """Scores word by word, of the model's own weights."""
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(130)], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id is not null"), labels)
    texts = {(r.doc_id, r.source): r.text or "" for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        own = {w for w in re.findall(r"[^\W\d_]+", texts[r.doc_id, r.source].lower())}
        found = own | {w[:n] + "*" for w in own for n in range(3, 8) if n <= len(w)}
        said = model.bias + sum(model.weights.get(f, 0.0) for f in found)
        assert abs(r[-2] - 1 / (1 + math.exp(-max(-35, min(35, said))))) < 1e-9 and r.predicted == int(r[-2] >= 0.3)


def test_toxicity(spark, none):
    draw = random.Random(6)
    rows = []
    for i in range(400):
        words = draw.choices(EN + DE, k=40)
        if i % 4 == 0:
            words[5] = draw.choice(("grmpf", "blargen", "blargst"))
            words[6] = "muslims"  # named more often in toxic rows
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    got = toxicity.scored(df.select("doc_id", "text"), model).collect()
    assert all((r.doc_id % 4 == 0) == bool(r.predicted) for r in got)
    assert model.score("the blargung and that") >= 0.3 and model.score("") < 0.3
    plain = toxicity.fitted([toxicity.words(t) for _, t in rows], np.array([float(i % 4 == 0) for i in range(400)]), pull=0.0)
    gap = abs(model.score("the muslims") - model.score("the jews"))
    assert gap <= abs(plain.score("the muslims") - plain.score("the jews"))
    assert toxicity.scored(none.select("doc_id", "text"), model).count() == 0 and toxicity.fitted([], np.zeros(0)).score("x") == 0


def test_toxicity_on_odd_rows(spark, docs, none):
    """Nulls, empty and very long texts, repeated rows and ids, ties at the bound, further columns, nothing to learn from."""
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(80)] + [(0, 0), (3, None), (None, 1), (200, 1), (7, 5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.scored(docs, model).columns == [*(c for c in docs.columns if c not in ("text", "score")), "score", "predicted"]
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("lang_pred", F.lit(1))
    assert toxicity.scored(odd, model).where("`a.b` = 1").count() == len(got) == langid.identified(odd, langid.learned(odd)).where("`a.b` = 1 and lang_pred in ('en', 'de', 'und')").count()
    assert len({r[-2] for r in got if r.doc_id in (200, 201)}) == 1
    assert toxicity.scored(none, model).count() == 0
    for empty in (toxicity.train(none, labels), toxicity.train(docs, labels.where("false"))):
        assert all(r[-1] == 0 for r in toxicity.scored(docs, empty).collect())
    at = toxicity.Model({"x": 0.0}, float(np.log(0.3 / 0.7)))
    assert [r[-1] for r in toxicity.scored(docs.select("doc_id", "text").limit(1), at, at.score("x")).collect()] == [1]


def test_suspects_are_found_and_evened():
    """Words that toxic texts name too often, most of whose texts are clean: the penalty takes their weight, not that of what is toxic."""
    draw = random.Random(31)
    texts, y = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        own = draw.choices(EN + DE, k=12)
        if draw.random() < (0.9 if toxic else 0.12):
            own.append("ruritanians")
        if draw.random() < 0.3:
            own.append("neighbours")
        if toxic:
            own.append(draw.choice(("grmpf", "blarg")) if draw.random() < 0.8 else "kaputt")
        texts.append(toxicity.words(" ".join(own)))
        y.append(float(toxic))
    y = np.array(y)
    plain, even = (toxicity.fitted(texts, y, pull=p) for p in (0.0, 0.1))
    assert even.pairs > 100 and any(g[0] == "ruritanians" for g in even.terms)
    neutral = [f"the {a} ruritanians {b}" for a in EN for b in DE]
    said = [np.mean([m.score(t) for t in neutral]) for m in (plain, even)]
    assert said[1] < 0.5 * said[0] and sum(even.score(t) >= 0.3 for t in neutral) <= sum(plain.score(t) >= 0.3 for t in neutral)
    assert even.score("the blarg and that") > 0.8


def test_word_pieces(spark, docs, none):
    draw = random.Random(7)
    for _ in range(150):
        starts, more = ({"".join(draw.choices("abc", k=draw.randint(1, 4))).encode() for _ in range(draw.randint(1, 8))} for _ in range(2))
        auto = wordpiece.Automaton(sorted(starts), sorted(more))
        for _ in range(60):
            word = "".join(draw.choices("abc", k=draw.randint(1, 10))).encode()
            assert auto.count(word) == wordpiece.greedy(word, starts, more), (word, starts, more)
    path = packing.vocabulary()
    starts, more = map(set, wordpiece.load(path))
    got = wordpiece.counted(docs, path).collect()
    assert len(got) == docs.count() and wordpiece.counted(none, path).count() == 0
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.n_tokens == sum(wordpiece.greedy(w, starts, more) for w in texts[r.doc_id].encode().split()) for r in got)


def test_neighbours(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(40)] + [(3000, None), (3100, []), (3200, [0.0] * 16), (3300, [float("nan")] * 16), (3400, [None] * 16), (None, x[1].tolist()), (3500, [1.0, 2.0]), (0, x[0].tolist())]
    own = graph_ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in graph_ann.nearest(graph_ann.index(own, shard=600), own.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([i for i, v in rows[:-8]])
    vectors = np.array([v for _, v in rows[:-8]], np.float32).astype(float)
    hit = 0
    assert sorted(got) == [i for i in range(0, 2100, 100) if i < 1500 or i == 2000]
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit += len({int(ids[b]) for b in best} & {v for v, _ in found})
        assert len(found) == 10 and all(s == d[ids == v][0] for v, s in found)
    assert hit / (10 * len(got)) >= 0.9
    assert [v for v, _ in got[2000]] == [7, *range(2001, 2010)]
    empty = own.where("false")
    assert graph_ann.nearest(graph_ann.index(empty), empty).count() == 0


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><div class="frame"><p>All rights of the house.</p></div>{}<footer>&copy; x</footer></body></html>'


def test_html(spark):
    body = "<article><h1>T &amp; {0}</h1><p><b>One {0}<br>two<p>Three\n {0}</p><form>no</form><div class='comments'><p>reader</p></div></article>"
    pages = [(i, "http://a.example/x", PAGE.format(body.format(i))) for i in range(8)]
    loose = [(20 + i, "http://b.example/x", PAGE.format(f"<div><p>Own text {i}</p></div>")) for i in range(8)]
    odd = [(40, None, None), (41, "http://[", ""), (42, "x", "<p>a < b &lt; c<!-- no --><i>d</i>e<script>x"), (43, "http://c.example", "<p>" * 3000 + "deep"), (44, "u", "plain")]
    df = spark.createDataFrame(pages + loose + odd, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r for r in html_text.extracted(df).collect()}
    for i in range(8):
        assert got[i].text == f"T & {i} One {i} two Three {i}"
        assert got[20 + i].text == f"Own text {i}"  # the frame is the same on each page of the host
    assert (got[40].text, got[41].text, got[43].text, got[44].text) == ("", "", "deep", "plain") and got[42].text == "a < b < c" + "de"
    assert all(r.n_chars == len(r.text) for r in got.values())
    other = {r.page_id: r.text for r in html_text.extracted(df, most_broadcast=0).collect()}
    assert other == {k: r.text for k, r in got.items()}
    assert html_text.extracted(df.where("false")).count() == 0
    assert html.unescape("&amp;") == "&"


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, own = own, stage(spark, own, str(tmp_path)).cache()
        assert own.columns == docs.columns, name
        assert own.count() <= before.count() or name == "mixing"
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in own.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in rows) == sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in again)


@pytest.mark.parametrize(("name", "change"), [("far from zero", lambda x: x + 3000), ("tiny", lambda x: x * 1e-25), ("huge", lambda x: x * 1e25), ("clusters", lambda x: x * 0.01 + 100 * (np.arange(len(x)) % 20)[:, None]), ("one far value", lambda x: np.where(np.arange(len(x))[:, None] == 5, 1e120, x))])
def test_neighbours_of_any_scale(name, change):
    """Recall against brute force in one shard, whatever the offset, scale and spread."""
    draw = np.random.default_rng(3)
    x = change(draw.normal(size=(900, 24)))
    own = graph_ann.frame(x)
    y = graph_ann.framed(x, *own)
    graph, entry = graph_ann.build(y)
    q = x[::30]
    found, _ = graph_ann.beam_search(y, (y * y).sum(axis=1), graph, entry, graph_ann.framed(q, *own), graph_ann.BEAM)
    hit = 0
    for i, v in enumerate(q):
        d = ((x - v) ** 2).sum(axis=1)
        near = found[i][found[i] >= 0]
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(near[np.argsort(d[near], kind="stable")[:10]]))
    assert hit >= 0.9 * 10 * len(q), name


def test_neighbours_in_units(spark, monkeypatch):
    """Several dimensions, empty shards, clashing columns, units of one block: the same rows without broadcasts, and no shuffle by dimension alone."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=12 if i % 3 else 7).tolist(), i, "x") for i in range(900)] + [(5000, [1e300] * 12, 1, "x"), (5100, [4.9e-324] * 12, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, rank string")
    own = graph_ann.usable(df)
    asked = own.where("vec_id % 10 = 0")

    def answers():
        return {(r.query_id, r.rank, r.vec_id, r.score) for r in graph_ann.nearest(graph_ann.index(own, shard=100), asked).collect()}

    want = answers()
    assert len({r[0] for r in want}) == 92 and all(r[1] <= 10 for r in want)
    monkeypatch.setattr(graph_ann, "UNIT", 1)
    monkeypatch.setattr(graph_ann, "ASKED", 8)
    monkeypatch.setattr(graph_ann, "MOST_DIMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert answers() == want
        plan = graph_ann.nearest(graph_ann.index(own, shard=100), asked)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(dim#" not in re.sub(r"hashpartitioning\(dim#\d+, (shard|block)", "", plan.split("MapInPandas")[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def own_text(page):
    """What the elements' tags and names leave of a page, without a tree."""
    return " ".join(t for _, t, own in html_text.Page(page).judged()[0] if own)


@pytest.mark.parametrize(("page", "text"), [
    ("<p>start <a href=/o'brien>link</a> mid</p><p>it's the end</p>", "start link mid it's the end"),
    ('<p title="it\'s>x</p>', "x"),
    ("<p class=comment-free>a</p><div class='ad-hoc'>b</div><section id='share-prices'>c</section>", "a b c"),
    ("<p>a<math><mi>x</mi></math> b <svg><text>t</text></svg>c <noscript>n</noscript> <select><option>o<option>p</select>d", "a x b t c n d"),
    ("<p>x<select><option>a<p>rest<div>more</div>", "x more"),
    ("<form><div>no<article><p>in a form</p></article></div></form>", "in a form"),
    ("<div hidden><form><article>no</article></form></div>yes", "yes"),
    ("<p>a &amp;lt; &lt;b&gt; < c &#233;", "a &lt; <b> < c é"),
    ("<table><tr><td>a<td>b<tr><td>c</div></table>d", "a b c d"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"),
    ("<p>x<title>y<p>z", "xy z"),
    ("<!-->a<!--->b<!-- c -->d<!-- e", "abd"),
    ("<p>one<!DOCTYPE x>two<?php x ?>three</ bogus>four <a <b", "onetwothreefour"),
    ("<head><title>no</title><p>yes", "yes"),
    ("<p>t<script>if(a<b)</script>u<p/>v<script>w", "tu v"),
    ("\x00\ud800<p>x", "\x00\ud800 x"),
])
def test_html_as_browsers_read_it(page, text):
    assert own_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 40_000 + "<p>x</p>" * 40_000, "<b>" * 60_000 + "</p>" * 60_000, '<p title="' * 60_000, "<p title='x\">" * 60_000, "<ul><li>" * 30_000, "<title>" * 60_000, "<p " + " " * 300_000, "<form>" + "<div>" * 20_000 + "<main>" * 20_000])
def test_html_is_linear(page):
    """Broken, deep and long pages of a quarter to half a megabyte: quadratic reading takes minutes."""
    began = time.time()
    html_text.Page(page).judged()
    assert time.time() - began < 5


def brute_tree(pages):
    """Texts of pages (id, url, html) by the tree, counted page by page in plain Python."""
    seen, by_host = set(), {}
    read = []
    for i, url, said in pages:
        page = html_text.Page(said)
        blocks, zone = page.judged()
        host = html_text.host_of(url)
        read.append((i, host, page, blocks, zone))
        own = (host, "\n".join(t for _, t, x in blocks if x))
        if own in seen:
            continue
        seen.add(own)
        for k, path in enumerate(page.path):
            if zone[k]:
                by_host.setdefault(host, {}).setdefault(path, []).append((page.style[k], page.content[k], zone[k]))

    def entropy(values):
        n, m = collections.Counter(values), len(values)
        return min(1.0, -sum(x / m * math.log(x / m) for x in n.values()) / math.log(min(m, html_text.SCALE)))

    low, high = set(), set()
    for host, paths in by_host.items():
        for path, rows in paths.items():
            if len(rows) >= html_text.LEAST_PAGES:
                style, content = (entropy([r[j] for r in rows]) for j in (0, 1))
                if 0.1 * style + 0.9 * content < html_text.LEAST:
                    low.add((host, path))
                elif max(r[2] for r in rows) == html_text.APART and min(style, content) >= html_text.OUTSIDE:
                    high.add((host, path))
    out = {}
    for i, host, page, blocks, zone in read:
        def above(k, page=page):
            while k >= 0:
                yield k
                k = page.parent[k]

        kept = [t for k, t, own in blocks if not any(zone[a] and (host, page.path[a]) in low for a in above(k)) and (own or any(zone[a] == html_text.APART and (host, page.path[a]) in high for a in above(k)))]
        out[i] = " ".join(kept or [t for _, t, own in blocks if own])
    return out, low, high


def test_html_tree_decides(spark):
    """Frames without telling names go, varied parts beside an article stay, renamed classes change nothing, brute force agrees."""
    draw = random.Random(12)

    def some(n):
        return " ".join(draw.choices(EN, k=n))

    def page(i, names, article):
        menu, note, main, rest, sale = names
        body = f"<h1>{some(4)} {i}</h1>" + "".join(draw.choice(("<p>{}</p>", "<pre>{}</pre>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>")).format(some(9)) for _ in range(draw.randint(1, 9)))
        body = f"<article>{body}</article>" if article else f"<div class={main}>{body}</div>"
        more = "".join(draw.choice(("<p>{}</p>", "<pre>{}</pre>", "<table><tr><td>{}</table>", "<blockquote>{}</blockquote>", "<dl><dt>{}</dl>")).format(f"part {some(6)} {i}") for _ in range(draw.randint(1, 9)))
        return f"<body><div class={menu}><ul><li>Start<li>News<li>Shop</ul></div><div class={note}><p>We keep your data.</p></div>{body}<div class={rest}>{more}</div><div class={sale}>Buy {some(3)} now</div><p class=end>All rights reserved</p></body>"

    first, second = ("top", "hint", "body", "annex", "sale"), ("qa", "qb", "qc", "qd", "qe")
    state = draw.getstate()
    for article in (True, False):
        texts = []
        for names in (first, second):
            draw.setstate(state)
            pages = [(i, f"http://h{i % 3 == 0}.example/", page(i, names, article)) for i in range(80)] + [(100 + i, "http://few.example/", page(i, names, article)) for i in range(3)]
            pages += [(200 + i, "http://hTrue.example/", pages[0][2]) for i in range(30)]
            want, low, high = brute_tree(pages)
            rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
            for most in (html_text.MOST_BROADCAST, 0):
                assert {r.page_id: r.text for r in html_text.extracted(rows, most_broadcast=most).collect()} == want
            assert low and bool(high) == article
            texts.append(want)
        assert texts[0] == texts[1]
        for i in range(80):
            assert "Start News" not in texts[0][i] and "We keep" not in texts[0][i] and "All rights" not in texts[0][i] and "part " in texts[0][i]
            assert ("Buy" in texts[0][i]) != article  # varied words in an unvaried place: beside an article it goes


def test_html_of_repeated_rows_and_clashing_columns(spark):
    """Each row of a page that comes again has its text; columns of the operator's own names are ignored; pages without url or html keep their rows."""
    body = "<article><h1>T {0}</h1><p>Words {0}</p></article><div>frame</div>"
    pages = [(i, f"http://a.example/{i}", body.format(i)) for i in range(6)] * 3 + [(7, None, None), (7, None, None), (None, "http://a.example/x", body.format("x"))]
    df = spark.createDataFrame([(*p, "a", 5, "b", [1]) for p in pages], "page_id long, url string, html string, host string, row int, low string, nodes array<int>").repartition(4)
    got = collections.Counter(tuple(r) for r in html_text.extracted(df).collect())
    want = collections.Counter((i, f"http://a.example/{i}", f"T {i} Words {i}", len(f"T {i} Words {i}")) for i in range(6) for _ in range(3))
    assert got == want + collections.Counter({(7, None, "", 0): 2, (None, "http://a.example/x", "T x Words x", 11): 1})


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_html_needs_no_names(spark):
    """The driver's pages with every class renamed and menus and footers as plain div elements give the same texts: place and tree decide."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r'class="\w+"', 'class="zq"'), r"<(/?)(nav|footer)\b", "<$1div")
    own, other = ({r.page_id: r.text for r in html_text.extracted(p).collect()} for p in (pages, pages.withColumn("html", bare)))
    assert own == other and len(own) == pages.count() and all(own.values())


@pytest.mark.parametrize("page", [
    '<body style="overflow-x:hidden"><p>{}</p></body>',
    '<body><div title="a hidden valley" data-id="ad"><p><a href="/hidden/path">{}</a></p></div></body>',
    '<body><div class="site has-sidebar"><article><div class="entry-header"><h1>{}</h1></div></article><div class="sidebar">no</div></div></body>',
    '<body><div class="site no-sidebar"><p>{}</p></div><div class="site-footer">no</div></body>',
    '<body><div class="widget"><article><h2 id="search">{}</h2><div class="comment-list">no, said at great length by a reader of the page</div></article></div></body>',
    '<body><div class="sidebar"><p>{}</p></div><div class="menu">no</div><p hidden>no</p></body>',
    '<body><article><pre>{} <span class="token comment"># kept</span></pre></article></body>',
])
def test_html_names_leave_the_article(page):
    said = own_text(page.format("The main text"))
    assert said == "The main text" + " # kept" * ("# kept" in page)


def test_html_keeps_articles_with_many_copies(spark):
    """A host's copies of one article, with or without an element that says so, and near copies, aren't taken for its frame."""
    page = "<body><div class='frame'><p>All rights.</p></div>{}</body>"
    own = "<{0}><h1>Head {1}</h1><div class='body'><p>Text {1}</p></div></{0}>"
    pages = [(1000 * h + i, f"http://h{h}.example/{i}", page.format(own.format(tag, 0 if i < 30 else i))) for h, tag in enumerate(("article", "div")) for i in range(40)]
    pages += [(2000 + i, "http://h2.example/", page.format(f"<article><h1>{i}</h1><div class='body'>{'The same' if i < 38 else 'Other'} text</div></article>")) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = {1000 * h + i: "Head {0} Text {0}".format(0 if i < 30 else i) for h in range(2) for i in range(40)}
    want |= {2000 + i: f"{i} {'The same' if i < 38 else 'Other'} text" for i in range(40)}
    for most in (html_text.MOST_BROADCAST, 0):
        assert {r.page_id: r.text for r in html_text.extracted(df, most_broadcast=most).collect()} == want


def test_word_pieces_cover_words_without_a_start_of_their_own():
    """The measure here is built on the vocabulary itself: the space mark is a byte like any other."""
    turn = wordpiece.byte_of()
    with open(packing.vocabulary(), encoding="utf-8") as f:
        pieces = {bytes(turn[c] for c in x) for x in json.load(f)["model"]["vocab"] if all(c in turn for c in x)}
    auto = wordpiece.Automaton(*wordpiece.load(packing.vocabulary()))

    def longest(word):
        at, out, said = 0, 0, b" " + word
        while at < len(said):
            at = next(e for e in range(len(said), at, -1) if said[at:e] in pieces)
            out += 1
        return out

    draw = random.Random(12)
    words = ["слово", "русский", "собака", "한국어", "हिन्दी", "ภาษาไทย", "一个没有空格的段落" * 20, "the", "naïve", "x" * 300]
    words = [w.encode() for w in words] + [bytes(b for b in draw.randbytes(draw.randint(1, 12)) if b not in b" \t\n\x0b\f\r") for _ in range(500)]
    assert [auto.count(w) for w in words if w] == [longest(w) for w in words if w]
    assert auto.count("русский".encode()) > 1 and auto.count(b"") == 0
    for _ in range(150):
        starts, more = ({"".join(draw.choices("abc", k=draw.randint(1, 4))).encode() for _ in range(draw.randint(1, 8))} for _ in range(2))
        auto = wordpiece.Automaton([*sorted(starts), b""], sorted(more))
        for _ in range(60):
            word = "".join(draw.choices("abc", k=draw.randint(1, 10))).encode()
            assert auto.count(word) == wordpiece.greedy(word, starts | {b""}, more), (word, starts, more)


def test_secrets_joined_to_words():
    """Random strings are found after words joined by / = - _, beside a pattern's span and without digits; words of no sample aren't."""
    model, draw = secrets.fitted(secrets.samples()), random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = lambda n, of=letters + "0123456789": "".join(draw.choices(of, k=n))
    for before, make in [
        ("client_account_key_value=", lambda: own(24)),
        ("/request/source/data/object/list/", lambda: own(24)),
        ("https://files.example.com/user/account/data/index/", lambda: own(24)),
        ("user-name-value-index-count-total-", lambda: own(20)),
        ("", lambda: own(24, letters)),
        ("AKIA" + "Q7" * 8 + "/", lambda: own(40)),
    ]:
        whole = 0
        for _ in range(200):
            secret = make()
            random_ = [(a, b) for a, k, b in secrets.scan(before + secret, model.ratio, model.least)[1] if k == 3]
            whole += any(a <= len(before) and b == len(before) + len(secret) for a, b in random_)
        assert whole >= 190, (before, whole)
    a, b = own(24), own(24)
    text = f"user_name={a}/client/request/response/list/result/{b}"
    assert [text[x:y] for x, k, y in secrets.scan(text, model.ratio, model.least)[1] if k == 3] == [a, b]
    plain = "umbrella_carpenter_lemonade wonderful-morning-sunlight/kitchenTableCloth -----------------Chapter ==================== com/pytest-dev/pytest/issues donaudampfschifffahrtsgesellschaft"
    assert secrets.scan(plain, model.ratio, model.least)[1] == []


def test_dedup_of_rows_that_share_an_id(spark):
    """Each class keeps a row of its own though an id names rows of several, and reruns keep the same."""
    draw = random.Random(31)
    a, b, c, d = (prose(draw, [f"{w}{k}" for w in EN for k in range(20)], 60) for _ in range(4))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (6, b, "x"), (7, c, "x"), (7, d, "x"), (8, d, "y"), (9, None, "x"), (9, None, "w"), (None, a, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, simhash.deduplicated(df.repartition(n)).collect()), key=str) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
    assert [r for r in runs[0] if r[0] != 9] == sorted([(1, a, "x"), (5, b, "z"), (7, c, "x"), (7, d, "x"), (None, a, "x"), (None, a, "x")], key=str)
    assert len([r for r in runs[0] if r[0] == 9]) == 1


def test_secrets_learned_from_every_document(spark):
    """All words of all documents count, also beyond what one task holds; the model is that of every word's strings, however rows are dealt."""
    letter = "etaoinshrdlucmfwypvbgk"
    words = [letter[k % 22] + letter[k // 22 % 22] + letter[k // 484 % 22] * 2 + letter[k // 10648] for k in range(25000)]
    rows = [[] for _ in range(4500)]
    for j, w in enumerate(words):
        for k in range(3):
            rows[(7 * j + 1500 * k) % 4500].append(w)
    texts = [" ".join([*row, *(["twice"] if i < 2 else [])]) for i, row in enumerate(rows)]
    docs = spark.createDataFrame([*enumerate(texts), (5000, None), (5001, "")], "doc_id long, text string").repartition(3)
    assert secrets.corpus_words(docs) == sorted(words)
    assert {tuple(r) for r in secrets.vocabulary(docs, 50).collect()} == {(w, 3) for w in words}

    groups = collections.defaultdict(list)
    for w in sorted(words):
        h = xxhash.xxh64_intdigest(w, 42)
        groups[(h - (h >> 63 << 64)) % (len(words) // secrets.GROUP)].append(w)
    strings = [x for k, own in groups.items() for x in secrets.corpus_strings(k, own, 1)]
    assert len(strings) == 25000 and 0.23 < np.mean([out for _, out in strings]) < 0.27
    seen, weight = collections.Counter(), secrets.CORPUS / 25000
    for t, out in strings:
        seen.update(zip(codes := [0, 0, *(secrets.ALPHABET.index(c) + 1 for c in t)], codes[1:], codes[2:], strict=False) if not out else ())
    more = np.zeros([len(secrets.ALPHABET) + 1] * 3)
    for key, n in seen.items():
        more[key] = n * weight
    labelled = secrets.samples()
    model, plain = secrets.learned(docs), secrets.Ratio([x for i, x in enumerate(labelled) if i % 4], more=more)
    assert np.allclose(model.ratio.table, plain.table, atol=1e-9)
    scores = [(plain.best(t), weight) for t, out in strings if out and len(t) >= 20] + [(plain.best(t), 1) for i, (t, own) in enumerate(labelled) if i % 4 == 0 and not own and len(t) >= 20]
    least = next(s for s, _ in sorted(scores) if sum(w for x, w in scores if x > s) <= 0.002 * sum(w for _, w in scores))
    assert abs(model.least - max(0.3, least)) <= 1.1 / secrets.STEPS and model.recall > 0.98
    again = secrets.learned(docs.repartition(7))
    assert np.array_equal(again.ratio.table, model.ratio.table) and again.least == model.least
    assert secrets.bound(np.array([3.0, 1.0, 2.0, 9.0]), np.array([1.0, 1.0, 1.0, 0.5]), 0.2) == pytest.approx(3.0)
    assert secrets.bound(np.arange(9.0), np.full(9, 0.1), 0.0) == pytest.approx(8.0)
