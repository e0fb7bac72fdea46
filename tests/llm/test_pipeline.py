"""The pipeline's rows against a brute-force version of its five stages, in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from strandlog.llm import langid, mixing, packing, secrets

WORD, M64 = re.compile(r"[^\x20\x09-\x0D]+"), (1 << 64) - 1
EN = "the and that with from have this there were they house water small people under night".split()
DE = "und der die das nicht ein mit auf für sich wasser haus kleine menschen unter nacht".split()


def documents():
    """(doc_id, text, lang, source): two languages, copies, near copies, secrets, long texts, no letters, nulls."""
    draw = random.Random(11)
    out = []
    for i in range(120):
        own = DE if i % 3 == 0 else EN
        out.append((i, " ".join(draw.choices(own, k=draw.randint(5, 90))), "de" if i % 3 == 0 else "en", f"s{i % 4}"))
    long = [f"{w}{k % 37}" for k, w in enumerate(draw.choices(EN, k=400))]
    for i in range(200, 230):  # near copies: one word differs
        own = list(long)
        own[draw.randrange(400)] = f"other{i}"
        out.append((i, " ".join(own), "en", "s1"))
    out += [(i, out[1][1].upper(), "en", None) for i in range(300, 340)]
    digits = hashlib.sha256(b"x").hexdigest()
    out += [(400, f"the password = hunter2hunter2 and {digits} were there", "en", "s2"), (401, f"und AKIA{'A1B2' * 4} nicht auf q8Zr2Lx9Vb4Nt7Kw1Yp6Dm3 der haus", "de", "s2")]
    out += [(500, None, "en", "s0"), (501, "", "en", "s0"), (502, "123 456 !!", None, "s0"), (503, "the small house " * 3000, "en", "s3"), (504, "un été à la maison", None, "s3"), (None, "there were small people", "en", "s0")]
    return out


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def slots(text):
    chars = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = n * 0x9E3779B9
            for c in chars[i : i + n]:
                h = (h * 0x100000001B3 + c) & M64
            h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & M64
            yield (h ^ h >> 29) >> 50


def by_language(docs):
    counts, rows = {}, Counter()
    for i, text, lang, _ in docs:
        if fold(i) != 2 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slots(text))
            rows[lang] += 1
    size = {x: sum(c.values()) + 0.5 * (1 << 14) for x, c in counts.items()}
    for doc in docs:
        if doc[1] and any(c.isalpha() for c in doc[1]):
            own = Counter(slots(doc[1]))
            said = [math.log(rows[x] / sum(rows.values())) + sum(n * math.log((counts[x][s] + 0.5) / size[x]) for s, n in own.items()) for x in counts]
            if 1 / sum(math.exp(x - max(said)) for x in said) >= 0.5:
                yield doc


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    own = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def firsts(docs):
    """The document with the least id of each component; all pairs are compared."""
    prints = [(d, fingerprint(d[1])) for d in docs]
    todo, out = sorted((x for x in prints if x[0][0] is not None), key=lambda x: x[0][0]), [d for d, _ in prints if d[0] is None]
    while todo:
        out.append(todo[0][0])
        front, todo = [todo[0]], todo[1:]
        while front:
            p = front.pop()[1]
            near = [x for x in todo if (x[1] ^ p).bit_count() <= 4]
            todo = [x for x in todo if (x[1] ^ p).bit_count() > 4]
            front += near
    return out


def chains(labelled, label):
    two, one = Counter(), Counter()
    for text, own in labelled:
        if own == label:
            codes = ["", "", *text]
            two.update(zip(codes, codes[1:], codes[2:], strict=False))
            one.update(zip(codes[1:], codes[2:], strict=False))
    return two, one


def masked(docs):
    alphabet = ["", *secrets.ALPHABET]
    models, seen = [], Counter()
    for _, text, _, _ in docs:
        seen.update(set(re.findall("[A-Za-z]{2,40}", text)))
    every = secrets.samples(sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w)))
    labelled = [x for i, x in enumerate(every) if i % 4]
    for label in (1, 0):
        two, one = chains(labelled, label)
        pairs, after = Counter(), Counter()
        for (a, b, _), n in two.items():
            pairs[a, b] += n
        for (b, _), n in one.items():
            after[b] += n
        models.append((two, one, pairs, after))

    def said(a, b, c):
        out = 0.0
        for sign, (two, one, pairs, after) in zip((1, -1), models, strict=True):
            back = (one[b, c] + 0.1) / (after[b] + 0.1 * len(alphabet))
            out += sign * math.log((two[a, b, c] + 5 * back) / (pairs[a, b] + 5))
        return out

    def best(text):
        codes = ["", "", *text]
        each = list(map(said, codes, codes[1:], codes[2:]))
        return max(sum(each) / len(each), *(sum(each[k : k + 20]) / 20 for k in range(len(each) - 19)))

    ordinary = sorted(best(t) for i, (t, own) in enumerate(every) if i % 4 == 0 and not own and len(t) >= 20)
    least = max(0.3, ordinary[math.ceil((len(ordinary) - 1) * 0.998)])
    patterns = [r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)"]
    for i, text, lang, source in docs:
        spans = [m.span() for p, least in zip(patterns, (8, 16, 32), strict=True) for m in re.finditer(p, text) if len(m[1]) >= least]
        base = list(spans)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if re.search("[A-Za-z]", m[0]) and len(set(re.findall("[A-Za-z0-9]", m[0]))) >= 8 and not any(a < m.end() and m.start() < b for a, b in base):
                if best(m[0]) > least:  # the random strings of these documents stand alone
                    spans.append(m.span())
        hidden = [any(a <= k < b for a, b in spans) for k in range(len(text))]
        starts = {a for a, _ in spans if not any(x < a < y for x, y in spans)}
        yield i, "".join("[secret]" if k in starts else "" if hidden[k] else c for k, c in enumerate(text)), lang, source


def mixed(docs):
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(WORD.findall(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(sizes.values())
    for _ in range(200):  # the water level at which the targets sum to 150 %
        level = (low + high) / 2
        low, high = (low, level) if sum(min(2 * n, weight[s] * level) for s, n in sizes.items()) >= 1.5 * sum(sizes.values()) else (level, high)
    for s in names:
        own = sorted((d for d in docs if d[3] == s), key=lambda d: (-len(WORD.findall(d[1])), d[0] is not None, d[0] or 0))
        rate, u = min(2 * sizes[s], weight[s] * high) / sizes[s], mixing.offset(17, s)
        for k, d in enumerate(own):
            yield from [d] * (math.floor(u + rate * (k + 1)) - math.floor(u + rate * k))


def pieces(docs):
    from tokenizers import Tokenizer

    said = Tokenizer.from_file(packing.vocabulary())
    for i, text, _, _ in docs:
        ids = [*said.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            yield i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))


def best_fit(lengths):
    """Bins of a best fit of one piece after the other, from large to small."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    return len(room)


def test_pipeline_as_brute_force(spark, tmp_path):
    docs = documents()
    rows = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known = list(by_language(docs))
    assert {d[0] for d in known}.isdisjoint({500, 501, 502}) and len(known) >= len(docs) - 4
    single = firsts(known)
    assert sum(200 <= (d[0] or 0) < 230 for d in single) < 30 and not any(300 <= (d[0] or 0) < 340 for d in single)
    clean = list(masked(single))
    assert sum("[secret]" in d[1] for d in clean) == 2 and not any("hunter2" in d[1] for d in clean)
    mix = list(mixed(clean))
    want = sorted(pieces(mix), key=str)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= best_fit(r.length for r in got) + 1


def test_mixture_tells_rows_apart(spark):
    """Equal ids, nulls in other places and other columns make other rows."""
    rows = [(1, "a b", None, "x"), (1, None, "a b", "x"), (1, "a b", "s", "x"), (1, "a b", "s", "y"), (1, "a b", "s", "y")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string")
    out = Counter(map(tuple, mixing.mixture(docs).collect()))
    again = Counter(map(tuple, mixing.mixture(docs.repartition(5)).collect()))
    assert out == again and {(r[2], r[3]) for r in out} == {(None, "x"), ("s", "x"), ("s", "y")}
    assert sum(2 * n for r, n in out.items() if r[1]) == pytest.approx(1.5 * 32, abs=4)


def test_secret_scan_learns_from_every_document(spark):
    """Words of three documents among 6,000 are ordinary to the stage: what joins them stays, a random string goes."""
    draw = random.Random(8)
    parts = "qx zj kv wq xz jk vq zw gx hq pz kx".split()
    odd = sorted({"".join(draw.choices(parts, k=draw.randint(2, 4))) for _ in range(500)})
    joined = ["".join(draw.choices(odd, k=4))[:40] for _ in range(50)]
    texts = [" ".join(draw.choices(EN + DE, k=12)) for _ in range(6000)] + [" ".join(draw.sample(odd, len(odd))) for _ in range(3)]
    texts += [f"the {w} house" for w in joined] + ["the q8Zr2Lx9Vb4Nt7Kw1Yp6Dm3 house", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    assert len(got) == len(texts) and {i for i, x in enumerate(texts) if got[i] != x} == {len(texts) - 2}
    assert got[len(texts) - 2] == "the [secret] house"


def test_language_id_learns_from_every_labelled_row(spark):
    """Twelve languages of one labelled row each among 45,000 rows of others are known to the stage, and the model has the counts of all rows."""
    draw = random.Random(3)
    of = lambda k: "".join(draw.choices([chr(0x4E00 + 100 * k + j) for j in range(6)], k=40))
    rows = [(i, of(i % 3), f"l{i % 3}") for i in range(45000)]
    learn = [i for i in range(50000, 50100) if fold(i) != 2]
    rows += [(learn[k], of(20 + k), f"rare{k:02}") for k in range(12)]
    rows += [(60000 + k, of(20 + k), None) for k in range(12)] + [(70000, None, "l0"), (70001, "", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, text, _ in rows if text}

    counts, n = {}, Counter()
    for i, text, lang in rows:
        if fold(i) != 2 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slots(text))
            n[lang] += 1
    for model in (langid.learned(docs, None), langid.train(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"), None, held=2)):
        assert model.langs == sorted(counts) and len(model.langs) == 15
        for k, x in enumerate(model.langs):
            size = sum(counts[x].values()) + 0.5 * (1 << 14)
            want = [round(math.log((counts[x][s] + 0.5) / size) * langid.FINE) for s in range(1 << 14)]
            assert max(abs(a - b) for a, b in zip(want, model.log_probs[:, k].tolist(), strict=True)) <= 1
            assert abs(model.prior[k] - math.log(n[x] / sum(n.values())) * langid.FINE) <= 1
