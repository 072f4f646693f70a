"""Spelling variants, quality rules and fill-in-the-middle against definitions, on hand-made rows and on whole tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("quern.llm")
from quern.llm import infill, quality, spelling  # noqa: E402
from quern.llm.queries import QUERIES  # noqa: E402

CLASH = "doc_id long, text string, word string, n int, base int, s int, e int, key int, salt int, measures int, fim int, `__quern_text` int, `__quern_id` int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "w", *range(10)) for r in rows], CLASH)


# Spelling


def vocabulary_by_definition(rows, least=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_definition(n):
    near = {w: set() for w in n}
    for a, b in combinations(n, 2):
        if distance_one(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


ROWS = [
    (1, "Telescope telescope TELESCOPE telescopes telescop étoiles étoilés ÉTOILES étoiles étoilés"), (2, "telescope " * 200 + "telescops telescops teletcope teletcope"),
    (3, None), (4, ""), (5, "short words only a b c"), (None, "telescope telescoqe telescoqe"), (2, "telescope telescopf telescopf"), (7, "x" * 300 + " " + "x" * 301 + " y"),
    (8, "x" * 300 + "!" + "x" * 301), (9, "naïveté×÷ naïveté×÷ ĀabcdefgĀabcdefg abcdefg"), (10, "aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa"),
]


def test_spelling_rows(spark):
    got = spelling.spelling_variants(clashing(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == variants_by_definition(vocabulary_by_definition(ROWS))
    assert {r["word"]: r["form"] for r in got}["teletcope"] == "telescope"
    assert spelling.spelling_variants(clashing(spark, ROWS).where("false")).count() == 0


def test_spelling_dense_neighbourhoods(spark):
    """Words over few letters, a hot prefix and a hot suffix: every window is parted down to one slot, and no pair is lost or doubled."""
    draw = random.Random(3)
    words = {"".join(draw.choices("ab", k=draw.randint(7, 9))) for _ in range(250)}
    words |= {"interna" + "".join(draw.choices("ab", k=draw.randint(0, 6))) for _ in range(80)}
    words |= {"".join(draw.choices("xyz", k=draw.randint(1, 4))) + "ization" for _ in range(60)}
    n = {w: draw.choice([2, 3, 30, 400, 5000]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = variants_by_definition(n)
    assert sum(r[4] for r in want) > 1000 and any(r[1] not in (None, r[2]) for r in want)  # forms of forms too
    for letters in (spelling.LETTERS, 60, 1):
        assert sorted(map(tuple, spelling.variants(df, letters=letters).collect()), key=str) == want, letters
    links = spelling.near_words(df, 60).collect()
    assert len(links) == len(set(links)) == sum(r[4] for r in want)


def test_tries_are_bounded(spark):
    """A third of all words share a prefix and a suffix: no trie has more letters than the bound, windows of one slot aside."""
    draw = random.Random(4)
    words = {"commonprefix" + "".join(draw.choices("abcdefghij", k=4)) + "commonsuffix" for _ in range(900)} | {"".join(draw.choices("klmnopq", k=10)) for _ in range(1800)}
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    biggest = 0
    for part in spelling._parted(spelling._halves(df), 500):
        for r in part.groupBy("key", "base", "s", "e").count().collect():
            biggest = max(biggest, r["count"] * (r["e"] - r["s"] + 1)) if r["e"] - r["s"] > 1 and r["count"] > 1 else biggest
    assert 0 < biggest <= 500


def test_trie_and_slots():
    draw = random.Random(5)
    parts = sorted({"".join(draw.choices("ab", k=draw.randint(0, 6))) for _ in range(60)})
    want = {(i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if distance_one(a, b)}
    got = list(spelling.Trie(parts).pairs())
    assert set(got) == want and len(got) == len(want)
    for a in parts:
        for b in parts:
            at = spelling.slot(a, b)
            assert (at is not None) == distance_one(a, b)
            if at is not None:
                assert at == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# Quality rules


def base_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def bands_by_definition(text):
    import zstandard

    data = (text or "").encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(b))
    limits = lambda b: next((low, high) for least, low, high in reversed(quality.BANDS) if len(b) >= least)
    good = lambda b: limits(b)[0] <= len(b) / size(b) <= limits(b)[1]
    chunks = [data[k : k + 4096] for k in range(0, len(data), 4096)]
    chunks = [c for c in chunks if len(c) >= 1024]
    bad = [c for c in chunks if not good(c)]
    return (len(data) / size(data) if data else None), len(chunks), len(bad), (not data or good(data)) and sum(map(len, bad)) * 4 <= len(data)


def prose(draw, n):
    """Sentences over an invented vocabulary of unequal frequency."""
    syllables = [c + v for c in "bcdfghklmnprstv" for v in "aeiou"] + ["tion", "ing", "er", "an", "st", "qu", "ch"]
    vocabulary = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(2000)]
    return " ".join(draw.choices(vocabulary, weights=[1 / (k + 3) for k in range(2000)], k=n)) + "."


def test_quality_rules(spark):
    draw = random.Random(6)
    noise = base64.b64encode(draw.randbytes(9000)).decode()
    spaced = " ".join(noise[k : k + 9] for k in range(0, 9000, 9))
    clean = [prose(draw, n) for n in (30, 90, 400, 3000, 30000)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [
        (10, None), (11, ""), (12, " \t\n "), (13, "a b\na b\n a b\n\n\na b"), (14, "same line of words here\n" * 40), (15, spaced), (16, "na " * 5000), (17, "é " * 19 + "é"),
        (18, clean[3] + " " + spaced), (19, clean[4] + " " + spaced), (20, "\n".join(f"{k} {w}" for k, w in enumerate(clean[2].split()))), (None, clean[2]), (2, clean[2]),
        (21, "".join(f"<tr><td>{k}</td></tr> <!-- cell cell cell -->" for k in range(600))), (22, "中文 " * 40), (23, "#*$%&|<>" * 9), (24, "word word x " * 30),
    ]
    df = clashing(spark, rows)
    got = {}
    for r in quality.measured(df, "found").collect():
        found = r["found"]
        got[r["doc_id"]] = found["kept"]
        text = dict(rows)[r["doc_id"]]
        base, bands = base_by_definition(text), bands_by_definition(text)
        assert tuple(found)[:6] == base, r["doc_id"]
        assert tuple(found)[6:] == (*bands[:3], bands[3] and not base[-1]), r["doc_id"]
    assert all(got[k] for k in range(5)) and got[19] and not any(got[k] for k in (10, 11, 12, 13, 14, 15, 16, 18, 21))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(k for k, _ in rows if got[k])
    assert quality.keep_good(df.where("false")).count() == 0


def test_numbering_and_repeats():
    draw = random.Random(7)
    text = "".join(draw.choices(["alpha ", "beta\n", "gamma\t", "x" * 50 + " ", "é  ", "\r\v\f"], k=400)).encode()
    for block in (1, 7, 64, 10**6):
        ids = quality.numbered(text, block)
        words = text.split()
        assert len(ids) == len(words) and len({*zip(ids.tolist(), words)}) == len({*words}) == len({*ids.tolist()})
    ids = np.array(draw.choices(range(3), k=300))
    by_hash = quality.repeated_words(ids, 4)
    assert by_hash == quality.repeated_words(ids, 4, lambda ids, w: np.zeros(len(ids) - w + 1, np.uint64)) > 0  # every hash collides


def test_quality_on_whole_tables(spark):
    """Every row of the smallest table by definition; of the next, what was written to be clean stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = []
    for r in docs.collect():
        base, bands = base_by_definition(r["text"]), bands_by_definition(r["text"])
        want.append((r["doc_id"], *base, *bands[:3], bands[3] and not base[-1]))
    assert sorted(map(tuple, QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.001").collect()), key=str) == sorted(want, key=str)
    kept = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.01")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    rows = kept.join(good, "doc_id").where("n_words >= 20").select("kept").collect()
    assert sum(r["kept"] for r in rows) >= 0.98 * len(rows) > 0


# Fill-in-the-middle


def units_by_definition(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)


def infill_by_definition(doc_id, text, unit="lines", rate=100, suffix_first=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = units_by_definition(text, unit)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < suffix_first:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    draw = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "one line", "two\nlines", "two\nlines\n", "é\nüñ\n中文\n\U0001f600x", "has <P> in it\nand more\n", "<S", "<P\n>S>\nM>", "a\r\nb\rc\x0bd e\n", "<M>"]
    texts += ["".join(draw.choices(["a", "é", "\n", "word ", "\U0001f600", "<", ">"], k=draw.randint(1, 3000))) for _ in range(60)] + ["line of text\n" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x\ny\nz"), (7, "again\nsame id\n"), (-3, "x\ny\nz")]
    df = clashing(spark, rows)
    for settings in ({}, {"unit": "characters", "rate": 60, "suffix_first": 20, "seed": 11}):
        got = infill.fill_in_middle(df, "made", **settings).collect()
        assert len(got) == len(rows)
        forms = Counter()
        for r, (doc_id, text) in zip(sorted(got, key=lambda r: str((r["doc_id"], r["text"]))), sorted(rows, key=lambda r: str((r[0], r[1])))):
            n, form, prefix, middle, output = infill_by_definition(doc_id, text, **settings)
            forms[form] += 1
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            assert tuple(r["made"]) == (n, form, prefix, middle, output, sha(output), sha(text or "")), doc_id
            assert infill.restore(output.encode(), form).decode() == (text or "")
        assert min(forms.values()) > 3 and len(forms) == 3
    assert infill.fill_in_middle(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, unit="pages")
    with pytest.raises(ValueError):
        infill.restore(b"text", "psm")


@pytest.mark.parametrize("density", [0.0, 0.003, 0.5, 1.0])
def test_rank_and_select(density):
    draw = np.random.default_rng(9)
    for size in (1, 7, 8, 511, 512, 513, 5000):
        flags = draw.random(size) < density
        bits, ones = infill.Bits(flags), np.flatnonzero(flags)
        assert bits.total == len(ones)
        assert [bits.select(k + 1) for k in range(len(ones))] == ones.tolist()
        for at in range(0, size, max(1, size // 50)):
            assert bits.rank(at) == int(flags[:at].sum())
    assert infill.Bits(np.zeros(0, bool)).total == 0
