"""The text queries over the smallest test tables: against their SQL, or against brute force over all rows."""

from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.llm import canonical, leaks, scan_noise
from verify import rows

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def found(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, SMALL).collect()]


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p5_counts"])
def test_query_equals_sql(spark, tables, name):
    mine, theirs = entry.queries()[name](spark, SMALL).toPandas(), tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs) and len(mine)


def test_p3_found_equals_one_reader_with_everything(spark, tables):
    """Vocabulary, shapes and repeated edges counted by loops, and every text read by one reader."""
    names = ["original_text", "source_text", "verified_text"]
    ledger = tables.sql(f"SELECT decision_id, document, page, {', '.join(names)} FROM manual_review_decisions").fetchall()
    units, fields = Counter(), []
    for key, document, page, *texts in ledger:
        for name, text in zip(names, texts, strict=True):
            if text:
                units[document, page, text] += 1
                fields.append((key, name, document, page, text))
    tokens = Counter()
    for (_, _, text), n in units.items():
        plain = "\n".join(scan_noise.lines_of(text)).lower()
        for token in set(scan_noise._TOKEN.findall(plain)):
            tokens[token] += n
    words = Counter()
    for token, n in tokens.items():
        for part in token.replace("/", "-").split("-") if not scan_noise._IDENTIFIER.search(token) else []:
            core = part.rstrip("!|$").lstrip("|$")
            if core.isalpha() and len(core) > 1:
                words[core] += n

    def page_of(page):
        try:
            return str(float(page))
        except (TypeError, ValueError):
            return page

    pages = defaultdict(set)
    for document, page, text in units:
        title = scan_noise._title(document) if document else ""
        for line in scan_noise.lines_of(text):
            if (rest := scan_noise.without_title(line, title)) is not None:
                pages[scan_noise.line_shape(rest)].add((canonical.canonical_text(document), page_of(page)))
    shapes = {s for s, at in pages.items() if len(at) >= scan_noise.SHAPE_PAGES}
    reader = scan_noise.Reader({w: n for w, n in words.items() if n > 1}, shapes)
    want = {(key, name, kind) for key, name, document, page, text in fields for kind in reader.read(text, document, page)[0]}
    assert set(found(spark, "p3_found")) == want and len(want) > 50


def test_p4_found_equals_brute_force(spark, tables):
    want = set()
    for name, key, column in (("value_index", "occurrence_id", "value"), ("manual_review_decisions", "decision_id", "original_text")):
        for k, v in tables.sql(f"SELECT {key}, {column} FROM {name}").fetchall():
            if v is not None and canonical.canonical_text(v) != v:
                want.add((name, k))
    assert set(found(spark, "p4_found")) == want and len(want) > 10


def test_p4_spellings_equal_brute_force(spark, tables):
    held = defaultdict(Counter)
    for (v,) in tables.sql("SELECT value FROM value_index WHERE value IS NOT NULL").fetchall():
        held[canonical.canonical_text(v)][v] += 1
    assert set(found(spark, "p4_spellings")) == {(s, len(c), sum(c.values())) for s, c in held.items() if len(c) > 1}


def test_p7_containers_hold_everything_once(spark, tables):
    specs = dict(tables.sql("SELECT spec_id, capacity_tokens FROM pack_specs").fetchall())
    documents = {d for (d,) in tables.sql("SELECT doc_id FROM documents").fetchall()}
    room, pieces, sizes = Counter(), Counter(), {}
    for spec, doc, piece, container, tokens in found(spark, "p7_containers"):
        room[spec, container] += tokens
        pieces[spec, doc] += 1
        sizes.setdefault((spec, doc), 0)
        sizes[spec, doc] += tokens
    assert {d for _, d in pieces} == documents and len(pieces) == len(documents) * len(specs)
    assert all(n <= specs[s] for (s, _), n in room.items())
    assert all(n == 1 or sizes[k] > specs[k[0]] for k, n in pieces.items())
    assert len({tuple(sizes[s, d] for s in specs) for d in documents}) and all(len({sizes[s, d] for s in specs}) == 1 for d in documents)


def test_p8_found_equals_brute_force(spark, tables):
    stretches = defaultdict(set)
    for item, text in tables.sql("SELECT item_id, item_text FROM eval_items WHERE item_text IS NOT NULL").fetchall():
        ws = leaks.words_of(text)
        for i in range(len(ws) - leaks.WINDOW + 1):
            stretches["".join(ws[i : i + leaks.WINDOW])].add(item)
    want = set()
    for doc, text in tables.sql("SELECT doc_id, text FROM documents WHERE text <> ''").fetchall():
        for join in (True, False):
            ws = leaks.words_of(text, join)
            stream, edges, at = "".join(ws), {0}, 0
            for w in ws:
                at += len(w)
                edges.add(at)
            for stretch, items in stretches.items():
                i = stream.find(stretch)
                while i >= 0:
                    if i in edges and i + len(stretch) in edges:
                        want |= {(doc, item) for item in items}
                        break
                    i = stream.find(stretch, i + 1)
    assert set(found(spark, "p8_found")) == want


def test_p9_found_has_every_open_document(spark, tables):
    got = found(spark, "p9_found")
    want = {d for (d,) in tables.sql("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 400 AND doc_id NOT IN (SELECT doc_id FROM level_labels)").fetchall()}
    assert {d for d, _ in got} == want and len(got) == len(want) and {b for _, b in got} <= {1, 2, 3, 4, 5}
