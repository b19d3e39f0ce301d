"""The training-data operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from tidewell.llm import bpe, common, exact, langid, lm, mixing, pii, quality, queries, simhash, suffix, toxicity

WORDS = ["".join(random.Random(i).choice("abcdeé") for _ in range(1 + i % 9)) for i in range(200)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(1)
    p = prose(rng, 40)
    texts = [None, "", "   \n", "x", "A" * 30_000, prose(rng, 20_000), p, p, p.upper(), p + " tail", "<|endoftext|> a  b", "mail a.b@c.de +49 30 1234567 1.2.3.4 4111 1111 1111 1111"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 1, "c") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", "en", "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, row string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, id int, row string")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe_is_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, own, rng = Tokenizer.from_file(path), bpe.TrieEncoder(path), random.Random(1)
    parts = [*"aeinst  \n\t'’éñß漢😀01½<|>\x1c\x85　", "<|endoftext|>", "'s", " the"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = tok.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in bpe.encode(odd, path).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
    back = bpe.decode(bpe.encode(odd, path), path).collect()
    assert {r["doc_id"]: r["text"] for r in back} == texts
    assert bpe.encode(none, path).count() == 0


def repeats(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if t[s : s + span] in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(t[s : s + span])
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("collection", [2048, 8])
def test_suffix_removal(spark, odd, none, monkeypatch, collection):
    monkeypatch.setattr(suffix, "COLLECTION", collection)
    rng, texts = random.Random(3), [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200]
    passages = [prose(rng, 60) for _ in range(4)]
    for _ in range(120):
        k = rng.random()
        texts.append(rng.choice(texts) if k < 0.2 else prose(rng, rng.randint(0, 30)) + rng.choice(passages)[: rng.randint(50, 300)] + prose(rng, 20) if k < 0.7 else prose(rng, 30))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(frame(spark, texts)).collect()}
    assert got == repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])
    if collection == 8:
        assert suffix.remove_repeats(odd).count() == odd.count()
        assert suffix.remove_repeats(none).count() == 0


def test_suffix_fragments_are_dealt_over_passes(spark, monkeypatch):
    rng, made, gone = random.Random(8), [], []
    texts = [prose(rng, 150) for _ in range(40)] * 5  # all repeat, so every fragment is a hit

    def staged(df, name):
        made.append((name, common.staged(df, name)))
        if name == "fragments":
            gone.append(made[-1][1].count())
        return made[-1][1]

    monkeypatch.setattr(suffix, "staged", staged)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove_repeats(frame(spark, texts)).collect()}
    assert got == repeats([(i, t.encode()) for i, t in enumerate(texts)])
    assert max(gone) < 0.4 * sum(gone)
    assert {name for name, df in made if Path(df._staged_at).exists()} == {"later", "sorted", "firsts"}


def test_fragment_digests_have_128_bits():
    raw = b"".join(b"%06d" % i for i in range(500))
    begin = np.arange(0, len(raw) - 60, 6)
    f, g = suffix.digests(raw, begin, begin + 60)
    want = [xxhash.xxh3_128_intdigest(raw[a : a + 60]) for a in begin.tolist()]
    assert [(int(a) % (1 << 64)) << 64 | int(b) % (1 << 64) for a, b in zip(f, g, strict=True)] == want


def test_columns_are_sorted():
    rng = random.Random(5)
    own = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    leads = [rng.randrange(len(x)) for x in own]
    for c, order, lcp in suffix.columns(own, leads):
        assert set(order.tolist()) == {i for i, x in enumerate(own) if -leads[i] <= c < len(x) - leads[i]}
        listed = [own[i][c + leads[i] :] for i in order]
        assert listed == sorted(listed)
        for a, b, k in zip(listed, listed[1:], lcp[1:], strict=False):
            assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])


def test_toxicity_learns(spark, none, odd):
    rng = random.Random(2)
    texts = [prose(rng, 60) + (" you stupid idiot " if i % 5 == 0 else " ") + prose(rng, 20) for i in range(600)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, learn=None)
    got = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in got]) > 0.97
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.fit(none, labels) is None and toxicity.score(odd, None).count() == odd.count()


def test_simhash_groups(spark, odd, none):
    rng = random.Random(4)
    texts = [None, "", "one", *[prose(rng, 200) for _ in range(30)]]
    texts += [t.replace(" ", "  ", 1).replace(t.split()[5], "zz", 1) for t in texts[3:25]] + texts[3:9]
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    for t, f in zip(texts, fps, strict=True):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else []))]
        assert f == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    lab = list(range(len(texts)))
    for _ in lab:
        for i in lab[:]:
            for j, g in enumerate(fps):
                if (fps[i] ^ g).bit_count() <= 4:
                    lab[j] = lab[i] = min(lab[i], lab[j])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", lab[i]) for i, f in enumerate(fps)}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("radius", "wide"), [(0, 1), (4, 1), (7, 1), (28, 1), (46, 2)])
def test_bit_sliced_pairs(radius, wide):
    """All pairs within the radius of blocks of all sizes that share words' passes, and of parts that meet; no others."""
    rng = random.Random(radius)
    sizes = [1, 2, 2, 3, 63, 64, 65, 130, 700, 1, 5, 2]
    fps = []
    for n in sizes:
        seed = rng.getrandbits(64 * wide)
        fps += [seed ^ sum({1 << rng.randrange(64 * wide) for _ in range(rng.randint(0, 2 * radius + 1))}) for _ in range(n)]
    whole, fps = fps, np.array([[x >> 64 * k & (1 << 64) - 1 for k in range(wide)] for x in fps], np.uint64)
    fps = fps[:, 0].copy() if wide == 1 else fps
    starts = np.concatenate([[0], np.cumsum(sizes)])
    meets = np.arange(len(sizes))
    meets[[6, 7]], meets[11] = [7, -1], -1
    for words, entries in ((2048, 1 << 15), (3, 7)):
        got = set()
        for a, b in simhash.pairs_within(fps, starts, meets, radius, words, entries):
            own = set(zip(a.tolist(), b.tolist(), strict=True))
            assert len(own) == len(a) and not own & got
            got |= own
        want = set()
        for k, m in enumerate(meets):
            for x in range(starts[k], starts[k + 1]) if m >= 0 else ():
                want |= {(x, y) for y in range(max(x + 1, starts[m]), starts[m + 1]) if (whole[x] ^ whole[y]).bit_count() <= radius}
        assert got == want


def test_long_files_are_dealt(spark, monkeypatch):
    """Files and loose groups of many parts give the same groups."""
    rng = random.Random(31)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for _ in range(400)})
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    monkeypatch.setattr(simhash, "FILE_ROWS", 16)
    monkeypatch.setattr(simhash, "PART_ROWS", 8)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from tidewell.operators.components import components

    links = simhash._links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), 4)
    group = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    seen = {}
    for x, k in zip(signed, label, strict=True):
        assert seen.setdefault(k, group.get(x, x)) == group.get(x, x)
    assert len(set(seen.values())) == len(set(label))
    test_pipeline_near_copies_by_brute_force(spark)


def test_exact(spark, odd, none):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower()) for r in odd.collect()]
    got = exact.deduplicate(odd).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len({t for _, t in rows})
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max((i for i in same if i is not None), default=None)
    assert exact.deduplicate(none).count() == 0
    blob = bytes(random.Random(1).randrange(256) for _ in range(100_000))
    assert b"".join(exact.chunks(blob)) == blob and max(map(len, exact.chunks(b"a" * 100_000))) <= exact.CHUNK_MOST


def base_spans(t):
    def luhn(d):
        return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 13 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_spans(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    parts = [*"ab1234567890 .-@+()_é漢😀\n", "a@b.co", "4111111111111111", " 4111 1111 1111 1111", "+49 (0)30 123456", "1.2.3.4", "256.1.1.1", "x [at] y.com"]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)], "a" * 50_000 + "@b.c" + ".d" * 5000]
    monkeypatch.setattr(queries, "documents", lambda *_: frame(spark, texts))
    for r in queries.op6_pii(spark, "").collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | set() if want else True
        assert r["n_phone"] == sum(w.startswith("phone") for w in want)
    assert pii.redact_spans(odd).count() == odd.count() and pii.redact_spans(none).count() == 0
    clean = frame(spark, ["write to a.b@c.de now", "nothing here"])
    assert {r["text"] for r in pii.redact(clean).collect()} == {"write to [email] now", "nothing here"}


def test_pii_context_decides(spark):
    """Spans are added in the context in which judged ones are true, and equal ones without it aren't."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        d = "4" + digits(14)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(d))))
        d += str((-total + (0 if good else rng.randint(1, 9))) % 10)
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    texts = []
    for _ in range(300):
        texts += [f"my credit card: {card(True)} thanks", f"the order {card(False)} left", f"the order {card(True)} left"]
        texts += [f"please call: +49 {digits(3)} {digits(3)} {digits(4)} soon", f"the part {digits(3)}-{digits(4)} is out"]
        texts += [f"please mail: a{digits(2)}@site.org soon", f"sold a lot at shop{digits(1)}.de again"]
    at = len(texts)
    texts += [f"my credit card: {card(False)} thanks", f"the order {card(False)} left"]
    texts += ["please call: 030-555-1234 soon", "the part 030-555-1234 is out"]
    texts += ["please mail: bob [at] site [dot] org soon", "sold bob [at] site [dot] org again"]
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["added"]] for r in pii.redact_spans(frame(spark, texts)).collect()}
    assert [got[at + i] for i in range(6)] == [["card"], [], ["phone"], [], ["email"], []]
    assert not any(got[i] for i in range(at) if "order" in texts[i] or "part" in texts[i] or "sold" in texts[i])


def test_mixing_targets_and_balance(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    by = {r["doc_id"]: s for r, s in ((r, rows[r["doc_id"]][2]) for r in got)}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    goal, weights = {}, dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True))
    left, free = 1.5 * sum(sizes.values()), set(weights)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        free -= over
    for s in goal:
        own = [r for r in got if by[r["doc_id"]] == s]
        assert all(math.isclose(r["target"], goal[s], rel_tol=1e-9) for r in own)
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 80 and all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50):
        size, pi = rng.integers(1, 9, n), np.full(n, rng.random())
        out = mixing.flight(size, pi, rng.random(n))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert math.isclose(out.sum(), pi.sum(), abs_tol=1e-6) and math.isclose((out * size).sum(), (pi * size).sum(), abs_tol=1e-6)


def test_lm_base_and_model(spark, odd, none):
    rng = random.Random(8)
    texts = [None, "", "Zebra", *[prose(rng, 50) for _ in range(60)], "unseen qqqq"]
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in lm.score(frame(spark, texts), F.col("doc_id") % 7 != 2).collect()}
    count, toks = Counter(), {}
    for i, t in enumerate(texts):
        toks[i] = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"]
        if i % 7 != 2:
            count.update(toks[i])
    n, v = sum(count.values()), len(count)
    for i, own in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
        assert got[i]["n_bytes"] == len((texts[i] or "").encode())
    assert lm.score(odd, F.col("doc_id") > 2).count() == odd.count() and lm.score(none, F.lit(True)).count() == 0


def segments_of(rng):
    segs = [[rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    return segs, np.array([x for s in segs for x in s]), np.concatenate([[0], np.cumsum([len(s) for s in segs])])


def test_lm_past_by_brute_force():
    segs, ids, starts = segments_of(random.Random(1))
    prior, times, place, guess, two, holds = lm.past(ids, starts)
    first, second, *_ = lm.TextModel.contexts(ids, ids.astype(np.uint32), starts)
    run_of, variety_of = dict(zip(first[0].tolist(), (first[1][0] // 2).tolist(), strict=True)), dict(zip(second[0].tolist(), (second[1][2] // 2).tolist(), strict=True))
    i = 0
    for s in segs:
        b = i
        for k, x in enumerate(s):
            last = lambda y, upto: max((j for j in range(upto) if s[j] == y), default=None)  # noqa: B023, E731
            g = last(s[k - 1], k - 1) if k else None
            g = None if g is None else g + 1
            assert prior[i] == (-1 if last(x, k) is None else b + last(x, k)) and times[i] == s[:k].count(x) and place[i] == k
            assert guess[i] == (-1 if g is None else b + g) and holds[i] == (g is not None and s[g] == x)
            assert two[i] == (g is not None and g >= 2 and s[g - 2] == s[k - 2])
            run = 0
            while run < k and holds[i - 1 - run] and i - 1 - run > b:
                run += 1
            assert run_of.get(i, min(run, 15)) == min(run, 15) and variety_of.get(i, len(set(s[:k])) * 15 // max(k, 1)) == len(set(s[:k])) * 15 // max(k, 1)
            i += 1


def test_lm_text_model_is_a_distribution():
    """What may come next has probabilities of one in all, each given by the decisions and, where a token is new, by itself."""
    rng, static = random.Random(2), np.full(12, 1 / 12)
    model = lm.TextModel()
    _, ids, starts = segments_of(rng)
    model.learn(ids, ids.astype(np.uint32), starts, np.zeros((2, lm.TEXT_GATES)), np.zeros((2, 2, lm.BUCKETS)))
    for n in (0, 1, 2, 7, 30):
        before, total = [rng.randrange(5) for _ in range(n)], 0.0
        for x in range(12):
            own = np.array([*before, x])
            cost, new = model.log10_of(own, own.astype(np.uint32), np.array([0, len(own)]), static[own])
            total += 10 ** cost[-1] * (static[x] if n in new else 1)
        assert 0.75 < total < 1 + 1e-6 and (n > 0 or math.isclose(total, 1))


def test_lm_spelling_shares_prefixes():
    rng, draw = random.Random(3), np.random.default_rng(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 8))) for _ in range(200)} | {b"x" * 100, b"y" * 9000})
    m = lm.Spelling(draw.random((5, 1 << 16, 2)).astype(np.float32) * 3, draw.random((lm.GATES, 5)).astype(np.float32), draw.random(lm.BUCKETS))
    together, alone = m.log10_of(words), [m.log10_of([w])[0] for w in words]
    assert np.allclose(together, alone)
    for w, want in zip(words[:20], together, strict=False):  # decision by decision
        got, text = 0.0, w + b" "
        for k in range(len(text)):
            slots, bit = lm.decisions(np.frombuffer(text, np.uint8), np.array([k]), np.array([k]), m.bits)
            for d in range(8):
                counts = [m.counts[i][slots[i][d]] for i in range(5)]
                logit = np.clip([math.log((c[1] + 0.02) / (c[0] + 0.02)) for c in counts], -12, 12)
                short, long = (min(int(math.log2(1 + c.sum())), 5) for c in counts[-2:])
                z = float(np.clip(m.weights[long * 4 + min(short // 2, 3)] @ logit, -16, 16))
                p = (1 / (1 + math.exp(-z)) + float(np.interp(z, np.linspace(-16, 16, lm.BUCKETS), m.refine))) / 2
                got += math.log10(min(max(p if bit[d] else 1 - p, 1e-7), 1))
        assert math.isclose(got, want, rel_tol=1e-3)


def test_lm_order_and_repeats_count(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    lines = [prose(rng, 12) for _ in range(12)]
    texts = ["\n".join(rng.choice(lines[:3]) for _ in range(12)) if i % 2 else prose(rng, 140) for i in range(80)]
    line = prose(rng, 30)
    mixed = (line + " " + line + " " + line).split()
    rng.shuffle(mixed)
    texts += [line + " " + line + " " + line, " ".join(mixed), "w" * 3_000_000 + " end"]
    got = {r["doc_id"]: r for r in lm.score(frame(spark, texts), F.col("doc_id") < 80).collect()}
    assert got[80]["base_score"] == pytest.approx(got[81]["base_score"]) and got[80]["score"] > got[81]["score"] + 5
    assert got[82]["n_tokens"] == 3 and got[82]["n_bytes"] == 3_000_004 and 0 < got[82]["bits_per_byte"] < 16


def test_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 50)
    rng = random.Random(6)
    texts = [prose(rng, 200).encode(), b"", b"q" * 500, b"a " * 90]
    own = {}
    for k, words in lm.segments(texts):
        own.setdefault(k, []).extend(words)
    assert own == {k: lm.tokens(t) for k, t in enumerate(texts)}


def test_rules_by_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice(["a", "b", "aa", "é", "漢", " ", " ", "\n", "#", "|", "\t", "\x85", "\r"]) for _ in range(rng.randint(0, 120)))
        w, seen, dup, cover = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0, set()
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                cover |= set(range(i, i + 5))
        assert quality.rules(t.encode())[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))


def test_forest_tells_junk(spark, odd, none):
    rng = random.Random(9)
    texts = [prose(rng, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, 80).split()) for i in range(400)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    got = quality.judge(docs, forest).collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 4 > 0) for r in got]) > 0.95
    assert quality.judge(odd, forest).count() == odd.count()
    assert quality.fit(none, labels) is None and quality.judge(odd, None).count() == odd.count()


def test_language(spark, odd, none):
    rng = random.Random(3)
    stems = {"en": "the and with that this was".split(), "de": "der und nicht auch sich eine".split(), "fr": "le les dans que est pour".split()}
    rows = [(i, " ".join(rng.choice(stems[k]) for _ in range(40)), k) for i, k in enumerate(list(stems) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(odd, model).count() == odd.count() and langid.fit(none).family is None
    assert langid.keep_identified(docs, model).count() == len(rows)


def test_pipeline(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            from tidewell.llm.common import staged

            docs = staged(stage(spark, docs, ""), "test")
        assert set(docs.columns) >= {"doc_id", "n_tokens", "token_ids"}


def test_pipeline_near_copies_by_brute_force(spark):
    """Kept rows of the near_dedup stage against all pairs, with similarities from below to above 0.8, a frequent passage and repeated rows."""
    import corpus_pipeline

    rng = random.Random(21)
    passage, texts = prose(rng, 30), [None, "", "x", "X", "a b c"]
    for i in range(60):
        own = prose(rng, rng.randint(8, 150)).split()
        texts.append(" ".join(own))
        for _ in range(3):
            copy = list(own)
            for _ in range(rng.randint(0, 1 + len(own) // 40)):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy).upper() if i % 3 else " ".join(copy))
        texts.append(passage + " " + prose(rng, rng.randint(1, 60)))
    rng.shuffle(texts)

    def shingles_of(t):
        w = (t or "").encode().lower().split()  # A-Z only
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles_of(t) for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert len(texts) / 4 < len(set(group)) < len(texts) * 3 / 4
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "").collect()]
    assert sorted(kept) == sorted(set(group))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(name, spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = queries.QUERIES[name](spark, folder)
    names = sorted(found.columns)
    plain = lambda v: round(v, 3) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    want = con.sql(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    assert got == sorted((tuple(plain(r[c]) for c in names) for r in want), key=repr)


def test_query_columns(spark):
    """Columns, types and held-out rows of the thin queries; their operators have tests of their own."""
    import zlib

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"] for r in queries.documents(spark, folder).collect()}
    for name, folds, key in (("op3_toxicity", 5, 0), ("op8_lm_scoring", 7, 2), ("op10_language_id", 4, 2)):
        found = queries.QUERIES[name](spark, folder)
        rows = found.collect()
        assert dict(found.dtypes)["held_out"] == "boolean" and dict(found.dtypes)["score"] == "double" and {r["doc_id"] for r in rows} == docs
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == key) for r in rows)


def test_forest_paths_by_hand():
    """Scores from path lengths walked one row and tree at a time."""
    rng = np.random.default_rng(4)
    x = rng.random((200, 4)) * [1, 5, 2, 9]
    forest = quality.Forest.grow(x, trees=30, sample=64)

    def path(row, t):
        node = 0
        while forest.column[t, node] >= 0:
            node = 2 * node + (2 if row[forest.column[t, node]] > forest.value[t, node] else 1)
        return forest.depth[t, node]

    want = [2 ** -(np.mean([path(row, t) for t in range(30)]) / forest.unit) for row in x]
    assert np.allclose(forest.score(x), want)


def test_votes_by_hand():
    """Language and score of texts from one machine after the other."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(w) for _ in range(30)).encode() for w in (["der", "und"], ["the", "and"], ["les", "que"], ["het", "een"]) for _ in range(30)]
    langs = [lang for lang in ("de", "en", "fr", "nl") for _ in range(30)]
    model = langid.LanguageModel.fit(texts, langs)
    asked = texts[::7] + [b"der les the", b"x"]
    got, scores = model.predict(np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in asked])]))

    def decide(votes, text):
        at, share = langid.frequencies(text)
        won, total = [0.0] * len(votes.classes), [0.0] * len(votes.classes)
        for k, (a, b) in enumerate(votes.pairs):
            margin = float(votes.weights[at, k] @ share) + votes.bias[k]
            p = 1 / (1 + math.exp(-max(-40, min(40, 3 * margin / votes.unit[k]))))
            total[a], total[b] = total[a] + p, total[b] + 1 - p
            won[a if p >= 0.5 else b] += 1
        best = max(range(len(won)), key=lambda i: won[i] + total[i] / len(won) / 2)
        return votes.classes[best], total[best] / (len(won) - 1) if len(won) > 1 else 1.0

    for text, lang, score in zip(asked, got, scores, strict=True):
        family, p = decide(model.family, text)
        own, q = decide(model.within[family], text)
        assert lang == own and math.isclose(score, p * q, rel_tol=1e-3)


def test_convolution_by_hand():
    """Logits from word vectors, filters of each width and the greatest value of each, one place at a time."""
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 12)).encode() for _ in range(40)]
    m = toxicity.train(texts, np.array([i % 2 for i in range(40)], np.float32), epochs=1)
    got, _ = toxicity.logits_of(m, texts, {})
    vocab = toxicity.Vocabulary()
    for text, logit in zip(texts, got, strict=True):
        ids = vocab.add(text.split())
        vectors = m.vectors(np.array(vocab.rows, np.int64), np.array(vocab.owner, np.int64), len(vocab.ids)) if len(vocab.ids) else np.zeros((0, toxicity.DIM))
        h, col = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(float(vectors[ids[p + j]] @ m.filters[:, col + j * toxicity.FILTERS + f]) for j in range(width)) for p in range(len(ids) - width + 1)]
                h.append(max(0.0, max(values, default=0.0) + m.bias[k * toxicity.FILTERS + f]) if values else 0.0)
            col += toxicity.FILTERS * width
        assert math.isclose(logit, float(np.array(h) @ m.out + m.out_bias), rel_tol=1e-3, abs_tol=1e-3)


def test_pipeline_rows_by_operators(spark, odd, tmp_path):
    """What each stage keeps, against plain versions of its rule, on rows with nulls, repeats and clashing columns."""
    import corpus_pipeline

    docs = spark.createDataFrame(odd.collect(), odd.schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, before, "").collect()
    assert sorted(r["doc_id"] or -1 for r in one) == sorted(r["doc_id"] or -1 for r in odd.collect() if any(map(str.isalpha, r["text"] or "")))
    two = stages["exact_dedup"](spark, before, "")
    groups = {}
    for r in odd.collect():
        groups.setdefault((r["text"] or "").encode().lower(), []).append(r["doc_id"])
    assert two.columns == odd.columns and Counter(r["doc_id"] for r in two.collect()) == Counter(max(ids, key=lambda i: (i is not None, i or 0)) for ids in groups.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_quality_threshold_is_of_all_labels(spark):
    """All of 20,000 labelled rows decide: the kept share of good rows is met to the row, where a sample meets it to its own error."""
    rng = random.Random(12)
    measured = spark.createDataFrame([(i, 50, 200, 0, 0, 0, [rng.gauss(4, 1), rng.random() / 50, rng.random() / 9, 0.0] if i % 10 else [rng.uniform(6, 30), rng.random(), 0.1, 0.1]) for i in range(20_000)], "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<double>")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 10 > 0 AS int) AS quality")
    forest = quality.fit(measured, labels)
    got = quality.judge(measured, forest).select("doc_id", "anomaly", "kept").collect()
    good, bad = (sorted(r["anomaly"] for r in got if bool(r["doc_id"] % 10) == want) for want in (True, False))
    at = good[math.ceil(0.985 * len(good)) - 1]
    assert forest.threshold == pytest.approx((at + min(x for x in bad if x > at)) / 2, abs=1e-12)
    scores = spark.createDataFrame([(x,) for x in good], "anomaly double")
    assert [quality.level(scores, k, gather=20) for k in (0, 9000, len(good) - 1)] == [good[0], good[9000], good[-1]]
