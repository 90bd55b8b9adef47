"""Text operators: fixtures with every dirty case, brute force, round trips and held-out accuracy."""

import json
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import canonical, duplicates, leaks, ledger, packing, reading_level, scan_noise, survivors


# canonical spellings

@pytest.mark.parametrize(
    ("written", "plain"),
    [
        (None, None), ("", ""), ("plain", "plain"), ("ＡＢ－１２", "AB-12"), ("état", "état"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("a\tb\nc", "a\tb\nc"),
        ("ТВХ-1", "TBX-1"), ("Shіft", "Shift"), ("kΩ", "kΩ"), ("kΩ", "kΩ"), ("Δp", "Δp"), ("α-phase", "α-phase"), ("Датчик", "Датчик"), ("Дaтчик", "Датчик"),
        ("нос Датчик", "нос Датчик"), ("測定値", "測定値"), ("wel−101", "wel-101"), ("x̱", "x̱"), ("ψύξη", "ψύξη"), ("51 °С", "51 °C"), ("a  B", "a  B"),
    ],
)
def test_canonical_text(written, plain):
    assert canonical.canonical_text(written) == plain
    assert canonical.canonical_text(plain) == plain


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_canonical_is_stable_and_composed(s):
    once = canonical.canonical_text(s)
    assert canonical.canonical_text(once) == once and unicodedata.is_normalized("NFC", once)


def test_every_pair_with_a_composed_letter_is_composed():
    pairs = 0
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", c):
            pairs += 1
            apart = "".join(chr(int(p, 16)) for p in parts)
            assert canonical.canonical_text(f"x {apart} y") == unicodedata.normalize("NFC", f"x {apart} y"), parts
    assert pairs > 900
    for syllable in "한글값":
        assert canonical.canonical_text(unicodedata.normalize("NFD", syllable)) == syllable
    assert canonical.canonical_text("か\u3099") == "が" and canonical.canonical_text("ا\u0655") == "إ" and canonical.canonical_text("ｶﾞ") == "ガ"


def test_the_quick_check_class_holds_all_that_composition_changes():
    outside = [c for x, y in canonical.STABLE_BLOCKS for c in range(x, y + 1)] + [*range(0x300), *range(0x30000, 0x110000)]
    assert canonical.unstable_points(outside) == []
    singles = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c < "\ue000" and not unicodedata.is_normalized("NFC", c)]
    assert len(singles) > 1000 and all(unicodedata.is_normalized("NFC", canonical.canonical_text(c)) for c in singles)


@pytest.mark.parametrize(
    ("written", "plain"),
    [
        ("می\u200cخواهم", "می\u200cخواهم"), ("क्\u200dष", "क्\u200dष"), ("👩\u200d🔧", "👩\u200d🔧"), ("❤\ufe0f\u200d🔥", "❤\ufe0f\u200d🔥"), ("1\ufe0f\u20e3", "1\ufe0f\u20e3"),
        ("🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"), ("葛\U000e0100", "葛\U000e0100"),
        ("a\u200db", "ab"), ("mi\u200cxer", "mixer"), ("a\ufe0fb", "ab"), ("a\u3164b\U000e0041", "ab"), ("\u200dx\u200c", "x"), ("e\u200b\u0301", "é"),
    ],
)
def test_invisible_characters_stay_where_they_belong(written, plain):
    assert canonical.canonical_text(written) == plain and canonical.canonical_text(plain) == plain


def test_quick_check_never_hides_a_change(spark):
    rng = random.Random(5)
    pool = canonical.INVISIBLE[0] + "​ ‑Ａ́Ω" + "".join(canonical.LOOK_ALIKES) + "abcé ΩД-"
    values = ["".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id INT, v STRING, _canonical STRING")
    want = {i for i, v in enumerate(values) if v is not None and canonical.canonical_text(v) != v}
    assert {r["id"] for r in canonical.disguised(df, "v").collect()} == want
    got = {r["id"]: r["c"] for r in canonical.canonicalize(df, "v", "c").collect()}
    assert got == {i: canonical.canonical_text(v) for i, v in enumerate(values)}


# duplicates

def fold(s):
    s, out = (s or "").casefold(), []
    for i, c in enumerate(s):
        between = 0 < i < len(s) - 1 and s[i - 1].isdecimal() and s[i + 1].isdecimal()
        if not c.isspace() and (between or not unicodedata.category(c).startswith("P")):
            out.append(c)
    return "".join(out)


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    docs, pages, texts = ["D 1", "d_1", "d-2", None], ["1", "01", "1.0", " 2", "x", None], ["A b.", "a B", "1.2", "1,2", "12", "", None, "STRASSE", "straße", "x" * 5000, "1. 2"]
    rows = [(i, rng.choice(docs), rng.choice(pages), rng.choice(texts), rng.choice(texts[:4])) for i in range(300)] + [(1000 + i, "hot", "1", "same", None) for i in range(200)] + [(0, "D 1", "1", "A b.", "A b.")]
    df = spark.createDataFrame(rows, "k BIGINT, document STRING, page STRING, o STRING, s STRING").withColumn("raw", F.lit("clash"))
    raw = F.col("raw")
    names = ["document", "page", "o", "s"]
    got = duplicates.duplicate_groups(df.dropDuplicates(["k"]), "k", {n: F.col(n) for n in names}, {n: duplicates.page_number(raw) if n == "page" else duplicates.folded(raw) for n in names})
    kept = {r["k"]: (r["keep"], r["copies"]) for r in got.collect()}

    def page(p):
        try:
            return float(p)
        except (TypeError, ValueError):
            return (p or "").strip()

    chosen = {r["k"]: r for r in df.dropDuplicates(["k"]).collect()}
    groups = defaultdict(list)
    for k, r in chosen.items():
        groups[fold(r["document"]), page(r["page"]), fold(r["o"]), fold(r["s"])].append(k)
    assert kept == {k: (min(g), len(g)) for g in groups.values() for k in g}


def test_no_duplicates_in_an_empty_table(spark):
    df = spark.createDataFrame([], "k BIGINT, a STRING")
    assert duplicates.duplicate_groups(df, "k", {"a": F.col("a")}, {"a": duplicates.folded(F.col("raw"))}).count() == 0


# survivors

def test_instants(spark):
    cases = [("2024-01-01T00:00:00Z", 0), ("2024-01-01 00:00:01", 1), ("2024-01-01T02:00:02.5+02:00", 2.5), ("2023-12-31T20:00:03-04:00", 3), ("", None), (None, None), ("soon", None)]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t STRING").select(ledger.instant(F.col("t"))).collect()
    assert [None if r[0] is None else r[0] / 1e6 - 1704067200 for r in rows] == [s for _, s in cases]


def test_survivors_field_by_field(spark):
    rows = [(1, "g", True, 9, "recovered", "A"), (2, "g", False, 1, "old", None), (3, "g", False, 5, " ", "B"), (4, "g", False, 5, "new", " \t"), (5, "g", False, 5, "tie", "C"), (6, "h", False, 1, None, ""), (7, "h", None, None, None, None)]
    df = spark.createDataFrame(rows, "id INT, g STRING, rec BOOLEAN, at INT, a STRING, b STRING")
    fields = {c: ledger.blank(F.col(c)) for c in "ab"}
    got = survivors.survivors(df, ["g"], "id", fields, [F.coalesce("rec", F.lit(False)), F.coalesce(-F.col("at"), F.lit(999))])
    assert {r["g"]: (r["n"], r["a_from"], r["a"], r["b_from"]) for r in got.collect()} == {"g": (5, 4, "new", 3), "h": (2, None, None, None)}
    assert survivors.survivors(df.limit(0), ["g"], "id", fields, [F.col("at")]).count() == 0


def test_truths_find_bad_and_many_valued_sources(spark):
    rng = random.Random(2)
    claims = []
    for g in range(120):
        for s in ("good1", "good2", "good3"):
            claims += [(g, s, v) for v in (f"t{g}", f"u{g}") if rng.random() < 0.9]
        claims += [(g, "bad", f"f{g}")] + ([(g, "bad", f"t{g}")] if rng.random() < 0.2 else [])
    claims += [(None, "good1", "x"), (1, None, "x"), (1, "good1", None)] + claims[:10]
    got = survivors.truths(spark.createDataFrame(claims, "g INT, s STRING, v STRING"), "g", "s", "v").collect()
    true = [r for r in got if r["v"][0] in "tu"]
    assert np.mean([r["is_true"] for r in true]) > 0.95 and not any(r["is_true"] for r in got if r["v"][0] == "f")
    assert max(Counter(r["g"] for r in got if r["is_true"]).values()) == 2


def em(claims, prior=0.5):
    """The same model by loops, until nothing moves."""
    said = {c for c in claims if None not in c}
    facts, present = defaultdict(set), defaultdict(set)
    for g, s, v in said:
        facts[g, v].add(s)
        present[g].add(s)
    values = defaultdict(list)
    for g, v in facts:
        values[g].append(v)
    p = {(g, v): (len(ss) + prior) / (len(present[g]) + 1) for (g, v), ss in facts.items()}
    a, b, c, d = survivors.PSEUDO_COUNTS
    while True:
        hit, alarm, true, false = (Counter() for _ in range(4))
        for (g, v), q in p.items():
            for s in present[g]:
                true[s] += q
                false[s] += 1 - q
                if s in facts[g, v]:
                    hit[s] += q
                    alarm[s] += 1 - q
        sens = {s: (hit[s] + a) / (true[s] + a + b) for s in true}
        spec = {s: 1 - (alarm[s] + c) / (false[s] + c + d) for s in true}
        new = {}
        for g, v in p:
            odds = math.log(prior / (1 - prior))
            for s in present[g]:
                odds += math.log(sens[s] / (1 - spec[s])) if s in facts[g, v] else math.log((1 - sens[s]) / spec[s])
            new[g, v] = 1 / (1 + math.exp(-odds))
        moved = max(abs(new[k] - p[k]) for k in p)
        p = new
        if moved <= 1e-6:
            return p, sens, spec


def test_estimate_equals_loops_and_finds_planted_quality(spark):
    rng = random.Random(12)
    planted = {"expert": (0.95, 0.97), "clerk": (0.7, 0.9), "machine": (0.8, 0.6), "old log": (0.4, 0.8)}
    claims = []
    for g in range(200):
        true, false = [f"t{i}" for i in range(rng.choice([1, 1, 2]))], ["f0", "f1"]
        for s, (sens, spec) in planted.items():
            claims += [(g, s, v) for v in true + false if rng.random() < (sens if v[0] == "t" else 1 - spec)]
    df = spark.createDataFrame(claims + claims[:50] + [(None, "clerk", "x"), (1, "clerk", None)], "g INT, s STRING, v STRING")
    facts, quality = survivors.estimate(df, "g", "s", "v", tolerance=1e-4)
    p, sens, spec = em(claims)
    got = {(r["g"], r["v"]): r["probability"] for r in facts.collect()}
    assert got.keys() == p.keys() and max(abs(got[k] - p[k]) for k in p) < 2e-3
    found = {r["s"]: (r["sensitivity"], r["specificity"]) for r in quality.collect()}
    assert all(abs(found[s][0] - sens[s]) < 2e-3 and abs(found[s][1] - spec[s]) < 2e-3 for s in planted)
    # and as planted: what a source claims of the true values, and denies of the others, in the groups it speaks about
    held, values = defaultdict(set), defaultdict(set)
    for g, s, v in claims:
        held[s].add((g, v))
        values[g].add(v)
    for s in planted:
        seen = [((g, v) in held[s], v[0] == "t") for g in {g for g, _ in held[s]} for v in values[g]]
        assert abs(found[s][0] - np.mean([c for c, t in seen if t])) < 0.1 and abs(found[s][1] - np.mean([not c for c, t in seen if not t])) < 0.15
    judged = [(k[1][0] == "t") == (v >= 0.5) for k, v in got.items()]
    assert np.mean(judged) > 0.9
    empty = survivors.estimate(df.limit(0), "g", "s", "v")
    assert [x.count() for x in empty] == [0, 0]


# scanned pages

READER = scan_noise.Reader({w: n for w, n in [("scanned", 900), ("burner", 500), ("whereas", 400), ("the", 5000), ("modern", 300), ("copy", 300), ("scan", 300), ("during", 900), ("was", 900), ("bumer", 3), ("approved", 400), ("items", 80)]}, {"rcv #"})


@pytest.mark.parametrize(
    ("text", "kinds", "repaired"),
    [
        (None, [], None), ("", [], ""), ("the burner", [], "the burner"), ("the bumer was sc@nned", ["misread"], "the burner was scanned"), ("THE BURNCR", ["misread"], "THE BURNER"),
        ("wher-\neas the", ["hyphen"], "whereas the"), ("wher¬\r\neas", ["hyphen"], "whereas"), ("scan-\ncopy", [], "scan- copy"), ("BTD-\n42208 was", [], "BTD- 42208 was"),
        ("- 12 -\nthe burner", ["page_no"], "the burner"), ("12\nthe", ["page_no"], "the"), ("13\nthe", [], "13 the"), ("Seite 12\nthe", ["page_no"], "the"), ("xii\nthe", ["page_no"], "the"), ("the\n9152.", [], "the 9152."),
        ("Fern Yard 00010\nthe", ["header"], "the"), ("FERN YARD 00O10 - Rev. 5\nthe", ["header"], "the"), ("Fern Yard 00010    Seite 12\nthe", ["header", "page_no"], "the"), ("12   Fern_Yard_00010\nthe", ["header", "page_no"], "the"),
        ("the fern yard\nwas", [], "the fern yard was"), ("wher-\nFern Yard 00010\neas", ["header", "hyphen"], "whereas"), ("SCA-4021 5 mA C12", [], "SCA-4021 5 mA C12"), ("Duringthe", [], "Duringthe"), ("wasapprovcd", ["misread"], "wasapproved"),
        ("the\n\nwas", [], "the\n\nwas"), ("bіrner", [], "birner"),
    ],
)
def test_read(text, kinds, repaired):
    assert READER.read(text, "Fern_Yard_00010", "12.0") == (kinds, repaired)


def noise_of(df, columns):
    found = {}
    for r in scan_noise.read_noise(df, "id", "document", "page", columns).collect():
        found.setdefault(r["id"], {})[r["field"]] = (r["kinds"], r["repaired"])
    return found


def test_read_noise_learns_from_all_rows(spark):
    clean = [(i, "Fern_Yard_00010", "3", "the heated burner was scanned", None, "") for i in range(30)]
    rows = [*clean, (100, "Fern_Yard_00010", "3", "the heatcd burner", None, "x" * 60000), (101, None, None, "p. 4\nthe bur-\nner", "the", None)]
    df = spark.createDataFrame(rows, "id INT, document STRING, page STRING, a STRING, b STRING, c STRING").withColumn("text", F.lit("clash")).withColumn("unit", F.lit(1))
    # fields without noise have no row
    assert noise_of(df, ["a", "b", "c"]) == {100: {"a": (["misread"], "the heated burner")}, 101: {"a": (["hyphen", "page_no"], "the burner")}}
    assert scan_noise.read_noise(df.limit(0), "id", "document", "page", ["a"]).count() == 0


def test_rare_words_of_a_large_vocabulary_are_known(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:12]]
    text = " ".join(many)
    rows = [(1, "d", "1", text), (2, "d", "1", text), (3, "d", "1", "a zebra"), (4, "d", "1", "the zebra"), (7, "d", "1", "zebra too"), (5, "d", "1", "the zeb-\nra"), (6, "d", "1", text), (8, "d", "1", text)]
    got = noise_of(spark.createDataFrame(rows, "id INT, document STRING, page STRING, a STRING"), ["a"])
    assert len(many) > 200_000 and got[5]["a"] == (["hyphen"], "the zebra")


def test_running_lines_without_the_title(spark):
    body = ["the burner of the annex was scanned", "the boiler of the works was entered", "the housing of the dock was weighed"]
    pages = [(i, "Fern_Yard_00010", str(i), f"STRICTLY CONFIDENTIAL - Harrow Works\n{body[i % 3]} {i}\nand signed in row {i * 7}\nRelea{'s5'[i % 2]}ed by Quality Office") for i in range(60)]
    rows = [*pages, (100, "Other", "1", "STRICTLY CONFIDENTIAL - Harrow Works\nstands here once"), (101, "Fern_Yard_00010", "70", "a line\nReleased by Quality Office\nin the middle")]
    got = noise_of(spark.createDataFrame(rows, "id INT, document STRING, page STRING, a STRING"), ["a"])
    assert got == {i: {"a": (["running"], f"{body[i % 3]} {i} and signed in row {i * 7}")} for i in range(60)}


def test_strokes_and_misreadings(spark):
    for read, true in scan_noise.CONFUSIONS:
        assert scan_noise.strokes(read) == scan_noise.strokes(true)
        assert scan_noise.misreads(f"x{read}y{read}z", f"x{true}y{true}z") and not scan_noise.misreads(f"x{read}y", f"q{true}y")
    assert not scan_noise.misreads("same", "same") and not scan_noise.misreads("cccp", "eeep") and scan_noise.misreads("0p0r0tc", "oporote")
    words = ["Modern Burner", "rn|!@$0156", "", None, "ﬁW"]
    got = spark.createDataFrame([(w,) for w in words], "w STRING").select(scan_noise.strokes_of(F.col("w"))).collect()
    assert [r[0] for r in got] == [w if w is None else scan_noise.strokes(w) for w in words]


def test_the_distributed_reader_equals_one_with_the_whole_vocabulary(spark):
    rng = random.Random(8)
    known = ["scanned", "burner", "whereas", "modern", "copy", "during", "approved", "items", "column", "winding", "the", "of", "row"]
    docs = ["Fern_Yard_00010", "Elm Dock 2", None]

    def line():
        words = [rng.choice(known) for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.4:
            i = rng.randrange(len(words))
            read, true = rng.choice(scan_noise.CONFUSIONS)
            words[i] = words[i].replace(true, read, 1)
        return " ".join(words) + rng.choice(["", "", ".", "!", " RAR-73741"])

    def text():
        lines = [line() for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            w = rng.choice(known[:10])
            lines[-1:] = [lines[-1] + " " + w[:3] + "-", w[3:] + " " + line()]
        if rng.random() < 0.3:
            lines.insert(rng.choice([0, len(lines)]), rng.choice(["Fern Yard 00010", "fern yard 0001O", "Elm Dock 2   7", "- 7 -", "xii", "7", "8", ""]))
        return rng.choice(["\n", "\r\n"]).join(lines)

    rows = [(i, rng.choice(docs), rng.choice(["7", "7.0", None]), text(), rng.choice([None, "", text()])) for i in range(500)]
    got = noise_of(spark.createDataFrame(rows, "id INT, document STRING, page STRING, a STRING, b STRING"), ["a", "b"])
    tokens = Counter()
    for t in (t for r in rows for t in r[3:] if t):
        tokens.update({k for k in scan_noise._TOKEN.findall(t.lower())})
    counts = Counter()
    for token, n in tokens.items():
        for part in token.replace("/", "-").split("-") if not scan_noise._IDENTIFIER.search(token) else []:
            core = part.rstrip("!|$").lstrip("|$")
            if core.isalpha() and len(core) > 1:
                counts[core] += n
    reader = scan_noise.Reader({w: n for w, n in counts.items() if n > 1}, set())
    want = {}
    for i, document, page, *texts in rows:
        for field, t in zip("ab", texts, strict=True):
            kinds, repaired = reader.read(t, document, page)
            if kinds:
                want.setdefault(i, {})[field] = (kinds, repaired)
    assert sum(len(v) for v in want.values()) > 200
    assert [(i, got.get(i), want.get(i)) for i in range(500) if got.get(i) != want.get(i)][:3] == []


# leaks

def words(n, rng):
    return [f"{rng.choice('abcdefgh')}{rng.choice('xyzuvw')}{rng.randint(0, 99)}" for _ in range(n)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(40, rng))) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    docs, want = [(9000, None), (9001, ""), (9002, "x " * 40000)], set()
    for d in range(400):
        body = words(80, rng)
        n = rng.choice([0, 0, 8, 11, 12, 13, 25, 40])
        if n:
            i = rng.randrange(20)
            own = items[i][1].split()
            s = rng.randint(0, 40 - n)
            part = own[s : s + n]
            styled = rng.choice([" ".join, "\n> ".join, lambda p: ", ".join(p).upper(), lambda p: " ".join(p).replace("a", "а")])(part)
            body = [*body[:40], styled, *body[40:]]
            if n >= 12:
                want.add((d, i))
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("score", F.lit("clash"))
    ev = spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    got = leaks.find_leaks(df, ev)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("longest_run >= 12").collect()} == want
    assert leaks.find_leaks(df, ev.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), ev).count() == 0


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(9)
    common = ["the", "of", "in", "a", "to", "and"]
    phrase = lambda n: [rng.choice(common) if rng.random() < 0.4 else words(1, rng)[0] for _ in range(n)]
    items = [(i, " ".join(phrase(rng.choice([14, 40, 60])))) for i in range(15)]
    docs = []
    for d in range(300):
        own, every = items[rng.randrange(15)][1].split(), rng.randint(2, 8)
        edits = [lambda w: ["changed"], lambda w: [], lambda w: [w, "added"]]
        copy = [x for k, w in enumerate(own) for x in (rng.choice(edits)(w) if k % every == every - 1 else [w])]
        docs.append((d, " ".join([*phrase(rng.randint(0, 60)), *copy, *phrase(rng.randint(0, 60))])))
    block, want, unseeded = leaks.Items(items), {}, 0
    for d, t in docs:
        ids = np.array([block.vocabulary.get(w, 0) for w in t.split()])
        for i, own in enumerate(block.ids):
            score, matched, run = leaks.smith_waterman(own, ids)
            if score >= leaks.LEAST_SCORE:
                want[d, i] = score, matched, run
                unseeded += run < leaks.GRAM
    df, ev = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["matched"], r["longest_run"]) for r in leaks.find_leaks(df, ev, edited=True).collect()}
    assert got == want and unseeded and sum(run < leaks.WINDOW for _, _, run in want.values()) > 100


def test_divided_words_and_compounds():
    item = "the fold-out for the jasper basement shows how the inherited manifold was entered twice today"
    block = leaks.Items([(7, item)])
    block.choose({})
    texts = ["x the fold-out for the jas-\nper basement shows how the inheri-\n> ted manifold was entered y", "the fold-\nout for the jasper basement shows how the inherited manifold was entered", "the out for the jasper basement shows how the inherited"]
    assert [(t, k) for t, k, _, _, run in block.leaks(texts) if run >= 12] == [(0, 7), (1, 7)]


def test_smith_waterman_equals_plain_table():
    rng = random.Random(8)
    for _ in range(60):
        a, b = [rng.randint(1, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 5) for _ in range(rng.randint(1, 15))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH), h[i - 1][j] + leaks.GAP, h[i][j - 1] + leaks.GAP)
        assert leaks.smith_waterman(np.array(a), np.array(b))[0] == max(map(max, h))


# reading level

def test_bands_on_held_out_documents(spark):
    rng = random.Random(6)
    common, rare = [f"{a}{b}" for a in "abcdefghij" for b in "xyzuv"], [f"{a}{b}{c}{d}" for a in "klmnopqrst" for b in "xyzuv" for c in "abcdefghij" for d in "qw"]
    rows = []
    for d in range(600):
        band = d % 5 + 1
        n, share = 4 + 4 * band, 0.1 * (band - 1)
        rows.append((d, ". ".join(" ".join(rng.choice(rare) if rng.random() < share else rng.choice(common) for _ in range(n)) for _ in range(15)) + ".", band))
    df = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(900, None), (901, ""), (902, "..."), (903, "w " * 50000)], "doc_id BIGINT, text STRING")
    described = reading_level.features(df, "doc_id", "text").cache()
    labels = spark.createDataFrame([(d, b if rng.random() < 0.9 else max(1, b - 1)) for d, _, b in rows if d % 3 == 0] + [(1, None)], "doc_id BIGINT, band INT")
    bands = reading_level.fit_bands(described, labels, "doc_id", "band")
    got = {r["doc_id"]: r["reading_band"] for r in reading_level.predict_bands(described, bands, "doc_id").collect()}
    assert len(got) == 604 and np.mean([got[d] == b for d, _, b in rows if d % 3]) > 0.9
    assert reading_level.fit_bands(described, labels.limit(0), "doc_id", "band") is None


# packing

def test_token_counts_are_those_of_the_library(spark):
    texts = ["hello world", "", None, "Zähler 12.5 kPa\n\n", "a" * 3000, "測定値 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    got = {r["id"]: r["tokens"] for r in packing.token_counts(df, "id", "t").collect()}
    encode = packing._encoding(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


@pytest.mark.parametrize("capacity", [10, 100])
def test_packing_keeps_every_document_whole(spark, capacity):
    rng = random.Random(capacity)
    sizes = [(i, rng.choice([0, 1, 3, capacity // 3 + 1, capacity // 2, capacity - 1, capacity, capacity + 7, 5 * capacity, rng.randint(1, capacity)])) for i in range(700)] + [(9999, None)]
    df = spark.createDataFrame(sizes, "id BIGINT, n INT").withColumn("part", F.lit("clash"))
    rows = packing.pack(df, "id", "n", capacity).collect()
    per, own = Counter(), defaultdict(list)
    for r in rows:
        per[r["container"]] += r["tokens"]
        own[r["id"]].append(r["tokens"])
    assert max(per.values()) <= capacity and {i: sum(own[i]) for i, _ in sizes} == {i: n or 0 for i, n in sizes}
    assert all(len(own[i]) == max(1, math.ceil((n or 0) / capacity)) for i, n in sizes)
    assert len(per) <= 1.06 * math.ceil(sum(n or 0 for _, n in sizes) / capacity) + 3
    assert packing.pack(df.limit(0), "id", "n", capacity).count() == 0


def test_layouts_hold_all_documents():
    groups = packing.group_lengths(np.array([90, 60, 50, 40, 30]), np.array([5, 7, 1, 9, 20]), 4)
    assert sum(n for _, n in groups) == 42 and [s for s, _ in groups] == sorted((s for s, _ in groups), reverse=True)
    found = packing.layouts(groups, 100)
    places = np.sum([n * np.array(c) for n, c in found], axis=0)
    assert (places >= [n for _, n in groups]).all() and all(sum(s * k for (s, _), k in zip(groups, c, strict=True)) <= 100 for _, c in found)


# entry

def test_payload_lines_are_read(spark, tmp_path):
    line = json.dumps({"page": 3.0, "document": "d", "recovered_from_historical_log": True, "timestamp_utc": "2024-01-01T00:00:00Z"}, indent=1)
    spark.createDataFrame([(1, "f", line), (2, "f", "{}")], "decision_id BIGINT, source_file STRING, payload STRING").write.parquet(str(tmp_path / "ledger_lines.parquet"))
    kinds = ", ".join(f"{c} STRING" for c in ledger.TEXTS)
    spark.createDataFrame([], f"decision_id BIGINT, {kinds}, recovered_from_historical_log BOOLEAN").write.parquet(str(tmp_path / "manual_review_decisions.parquet"))
    rows = {r["decision_id"]: r for r in ledger.entries(spark, str(tmp_path)).collect()}
    assert (rows[1]["page"], rows[1]["recovered"]) == ("3.0", True) and rows[2]["recovered"] is False and rows[2]["at"] is None


@pytest.mark.parametrize("every", [3, 4, 5, 6, 8, 10])
def test_recall_of_edited_copies(spark, every):
    """One word in ``every`` replaced: what the alignment of all pairs scores is found, all of it."""
    rng = random.Random(every)
    items = [(i, " ".join(words(48, rng))) for i in range(60)]
    docs = []
    for i, text in items:
        copy = [f"other{rng.randint(0, 10**6)}" if k % every == i % every else w for k, w in enumerate(text.split())]
        docs.append((i, " ".join(words(30, rng) + copy + words(30, rng))))
    frames = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(*frames, edited=True).collect()}
    block = leaks.Items(items)
    score = lambda d, i: leaks.smith_waterman(block.ids[i], np.array([block.vocabulary.get(w, 0) for w in leaks.words_of(docs[d][1])], np.int64))[0]
    want = {(d, i) for d in range(60) for i in range(60) if score(d, i) >= leaks.LEAST_SCORE}
    assert got == want and (every == 3 or {(i, i) for i in range(60)} <= want)


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(words(30, rng))) for i in range(12)]
    docs = [(d, " ".join(words(10, rng) + items[d % 12][1].split()[5:25])) for d in range(40)]
    frames = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    whole = sorted(map(tuple, leaks.find_leaks(*frames).collect()))
    blocks = leaks.item_blocks
    monkeypatch.setattr(leaks, "item_blocks", lambda *a: blocks(*a, block_words=100))
    assert len(list(leaks.item_blocks(frames[1], "item_id", "item_text"))) > 3
    assert sorted(map(tuple, leaks.find_leaks(*frames).collect())) == whole and len(whole) == 40


def test_alignment_needs_no_table_of_both_texts():
    import tracemalloc

    a, b = np.arange(1, 2001), np.arange(1, 20001) % 5000
    tracemalloc.start()
    assert leaks.smith_waterman(a, b)[2] == 2000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
