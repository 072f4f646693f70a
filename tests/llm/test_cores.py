"""The operators' cores against brute force, without Spark."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import decontam, langid, media, packing, shared, simhash, suffix, wordpiece

P = pytest.importorskip("public_tokenizers")


@given(st.lists(st.integers(0, 2**40), unique=True, max_size=50))
def test_packed_cells_round_trip(cells):
    a = np.array(sorted(cells), np.uint64)
    assert (shared.unpack_cells(shared.pack_cells(a)) == a).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 20))
def test_rolling(values, k):
    h = np.array(values, np.uint64)
    m = 0x9E3779B97F4A7C15
    want = [sum(v * m ** (k - 1 - j) for j, v in enumerate(values[i : i + k])) % 2**64 for i in range(max(0, len(values) - k + 1))]
    assert shared.rolling(h, k).tolist() == want


def test_ball_hashing_finds_every_component():
    rng = random.Random(5)
    fps = set()
    for _ in range(150):
        b = rng.getrandbits(64)
        fps.add(b)
        for _ in range(rng.choice([0, 1, 4, 12])):
            x = b
            for i in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << i
            fps.add(x)
    fps = sorted(fps)
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64))], ["fp"])
    packets = pa.Table.from_batches(list(simhash._emit(5)(iter([batch]))))
    links = set()
    for k in range(5):
        got = simhash._meet(packets.filter(pc.equal(packets["bucket"], k)))
        links |= {(a & (2**64 - 1), b & (2**64 - 1)) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist())}

    def roots(pairs):
        up = {x: x for x in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert roots(links) == roots([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", None, "One", "a B", "the Quick brown fox jumps over the quick brown fox", "x y z x y z x"):
        w = (text or "").lower().split()
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        want = 0
        for bit in range(64):
            if sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) * 2 > len(grams):
                want |= 1 << bit
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("length", [4, 10, 100])
def test_interval_expansion(length):
    rng = random.Random(length)
    for _ in range(25):
        letters = rng.choice([b"ab", b"abcdefgh", bytes(range(256)), b"a"])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 3 * length))) for _ in range(4)]
        segments = list(dict.fromkeys(s for s in (b"".join(rng.choice(pool)[rng.randint(0, length // 2) :] for _ in range(rng.randint(1, 3))) for _ in range(8)) if len(s) >= length))
        if not segments:
            continue
        seen = set()
        for s, flags in zip(segments, suffix.repeats(segments, length)):
            for i in range(len(s) - length + 1):
                x = s[i : i + length]
                assert flags[i] == (x in seen)
                seen.add(x)


def test_png_filters_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    for channels in (1, 3):
        x = rng.integers(0, 256, (7, 12), dtype=np.uint8)
        for kind in range(5):
            rows = media.filter_rows(x, channels, kind)
            assert (media.unfilter_rows(np.full(7, kind, np.uint8), rows, channels) == x).all()
        data = media.encode_png(x, channels)
        got, c = media.decode_png(data)
        assert c == channels and (got == x).all()
    for at in range(30, len(data) - 4, 7):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Exception):
            media.decode_png(bytes(bad))


@pytest.mark.parametrize("text", ["", "a", "é" * 95, "x" * 192, "y" * 193, "long " * 5000])
def test_media_payload(text):
    samples, _ = media.decode_png(media.to_media(text))
    payload = samples.tobytes()
    assert len(payload) % 192 == 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ") and len(payload) >= 192


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    e, library = packing.Encoder(P.path(packing.VOCABULARY)), Tokenizer.from_file(P.path(packing.VOCABULARY))
    assert e.merge is not None
    rng = random.Random(1)
    letters = list("aB é1² \t\n\r'sñ½ \x85\xa0.,'ll _-ſ 中😀\x1c") + [" "] * 3
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> z", "a<|endoftext|>b <|endoftext| >", "word " * 3000]
    low = [chr(c) for c in range(0x250)]  # every character that the faster loop takes, in every kind of surrounding
    texts += [f"a{c}b {c} 1{c}2  {c}{c}'s{c}é{c}{c}{c} {c}1{c}." for c in low] + ["".join(rng.choice(low) for _ in range(60)) for _ in range(500)]
    texts += [f"x{chr(c)} {chr(c)}{chr(c + 1)}1" for c in range(0x250, 0x30000, 0x95) if not 0xD800 <= c < 0xE000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [e(t).tolist() for t in texts] == want
    assert want[3000] == [50256, 1976]


def naive_best_fit(counts, capacity):
    """Sequences that best fit by falling length takes, one piece at a time."""
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - length)
    return len(gaps)


def packed_by_rounds(counts, capacity):
    runs, rounds = packing.settle([(packing.DOC, k, 0, n, 0, 0) for k, n in counts.items() if n], capacity), 0
    while any(r[0] in (packing.DOC, packing.WAITS) for r in runs):
        ranges = defaultdict(list)
        for r in runs:
            ranges[r[1] // 10].append(r)
        runs = packing.settle(packing.sweep([x for part in ranges.values() for x in packing.sweep(part, capacity)], capacity), capacity)
        rounds += 1
    return [r[1:] for r in runs if r[0] == packing.PLACED], rounds


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=20))
def test_rounds_place_every_piece_once(counts):
    runs, rounds = packed_by_rounds(counts, 32)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for i in range(n):
            used[first + i].append((offset, length))
            ranks[length].append(rank + i)
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in counts.items() if n)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(used) == list(range(len(used)))
    naive = naive_best_fit(counts, 32)
    assert len(used) <= naive + max(1, naive // 20) and rounds < 120


def test_rounds_pack_like_naive_best_fit():
    rng = random.Random(7)
    for _ in range(6):
        top = rng.choice([200, 600, 1024])
        counts = Counter(min(1024, 1 + int(rng.expovariate(1 / rng.choice([60, 250, 500])))) if rng.random() < 0.8 else rng.randint(1, top) for _ in range(3000))
        used = len({first + i for _, _, n, first, _ in packed_by_rounds(counts, 1024)[0] for i in range(n)})
        assert used <= naive_best_fit(counts, 1024) * 1.01 + 1


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_word_pieces_greedy():
    vocab = wordpiece.load_vocabulary(P.path(wordpiece.VOCABULARY))
    automaton, known, most = wordpiece.Automaton(vocab), set(vocab), max(map(len, vocab))

    def greedy(w):
        n = a = 0
        while a < len(w):
            b = min(len(w), a + most)
            while w[a:b] not in known:
                b -= 1
            a, n = b, n + 1
        return n

    rng = random.Random(3)
    for _ in range(3000):
        w = b" " + bytes(rng.choice(b"abetinghrn\xc3\xa9,.=-_13 ") for _ in range(rng.randint(0, 25)))
        assert automaton.count(w) == greedy(w)


def test_word_pieces_backtrack():
    v = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"bcx", b"cde"]
    a = wordpiece.Automaton(v)
    assert a.count(b"abcx") == 3  # ab, c, x
    assert a.count(b"abcdab") == 2
    assert a.count(b"abcde") == 2  # abcd, e
    assert a.count(b"") == 0


def test_ngrams_by_brute_force():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "c9", "é", "d"])
    items = [(str(k), " ".join(word() for _ in range(rng.randint(0, 6)))) for k in range(12)] + [(None, "a a a")]
    grams = decontam.Ngrams(items, 4)
    get = decontam._Numbers(grams.ids).__getitem__
    for _ in range(200):
        words = decontam.words_of(", ".join(word() for _ in range(rng.randint(0, 14))))
        flags, hit = [False] * len(words), set()
        for k, (_, text) in enumerate(items):
            w = decontam.words_of(text)
            for a in range(max(1, len(w) - 3) if w else 0):
                x = w[a : a + 4]
                for i in range(len(words) - len(x) + 1):
                    if words[i : i + len(x)] == x:
                        hit.add(k)
                        flags[i : i + len(x)] = [True] * len(x)
        got, items_hit = grams.hits(np.fromiter(map(get, words), np.uint64, len(words)))
        assert got.tolist() == flags and items_hit == hit


def _model():
    import pandas as pd

    texts = {"xx": ["the cat sat on the mat and the dog ran"] * 3, "yy": ["der hund und die katze sind zu haus"] * 3}
    rows = Counter()
    for lang, ts in texts.items():
        x, first, sizes = langid.read(ts)
        for f, n in zip(first, sizes):
            for s in range(f, f + n + 1):
                rows[lang, "".join(map(chr, x[s : s + langid.ORDER]))] += 1
    return langid.Model(pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "gram", "n"]))


def test_language_models_are_distributions():
    m = _model()
    letters = sorted({chr(c) for k in m.hashes for c in range(32, 123)})
    known = [c for c in letters if c == " " or c.isalpha()]
    for context in ("the", "   ", "zzz", "der", "at "):
        grams = np.array([[ord(c) for c in context + x] for x in known], np.uint32)
        p = np.exp(m._look(grams))
        seen = np.exp(m._look(np.array([[ord(c)] for c in known], np.uint32)))
        new = np.isclose(seen, np.exp(m.unseen)).all(axis=1)  # letters of no model share what is kept for unseen ones
        assert (p[~new].sum(axis=0) <= 1 + 1e-9).all() and (p > 0).all()


def test_language_predictions():
    m = _model()
    got = m.predict(["the dog sat", "die katze", None, "", "123 !?", "THE CAT"])
    assert got["lang_pred"].tolist() == ["xx", "yy", "und", "und", "und", "xx"]
    assert got["rejected"].tolist()[2:5] == [True] * 3 and got["score"].between(0, 1).all()


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), max_size=60), st.sampled_from([1, 2**40, 2**58]))
def test_touched_cells(pairs, scale):
    from quern.llm import substring

    pairs = sorted(pairs, key=lambda p: p[1])
    cells, docs = np.array([c * scale for c, _ in pairs], np.uint64), np.array([d * 7 for _, d in pairs], np.int64)
    got, several = substring._touched(cells, docs)
    by = defaultdict(set)
    for c, d in pairs:
        by[c * scale].add(d)
    assert got.tolist() == sorted(by) and several.tolist() == [len(by[c]) > 1 for c in sorted(by)]
