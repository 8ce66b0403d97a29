"""The corpus operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bm25, components, encoding, html_text, media_jpeg, mixing, packing, queries, simhash, substring_dedup, token_counts, token_files, toxicity
from gridloom.llm.common import scratch_path

BYTE, WORD = queries.vocabulary(queries.BYTE_VOCABULARY), queries.vocabulary(queries.WORD_VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, predicted string, size string, key long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", str(rng.randrange(50))]) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, special strings, clashing extra columns."""
    texts = [prose(i, 80 + i) for i in range(24)]
    texts[5] = texts[4]
    texts[7] = texts[6] + " end"
    texts += [None, "", " \n\t ", prose(99, 30_000), "x" * 5000, "a<|endoftext|>b  <|endo", "Ünïcode straße İ Σ 漢字 😀\n\nnext\r\n line", "word", "two words"]
    made = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 3 else f"src{i % 4}", None, 1.5, i, "p", "s", 3) for i, t in enumerate(texts)]
    return [*made, made[2], made[2], (None, "orphan text", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row) -> str:
    return row[1] or ""


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


# --- 1 toxicity


def toxic_table(spark, n: int = 1500):
    """Insults are toxic only with a mention of a group; either alone is not."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(i, 30).split()
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["fool"] * insult + ["outsiders"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_interactions_and_generalises(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.detect_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_toxicity_learns_pairs_that_say_nothing_alone(spark):
    """Toxic if exactly one of two words is there: neither depends on the label by itself."""
    rng, docs, labels = random.Random(5), [], []
    for i in range(2400):
        words = prose(i, 12).split()
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words += ["zorn"] * one + ["quell"] * two
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(one != two)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, labels)
    assert {toxicity.hashed_terms(w)[0] for w in ("zorn", "quell")} <= set(machine.place)
    held = [r for r in toxicity.score_documents(docs, machine).join(labels, "doc_id").collect() if r.held_out]
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.97 * len(held)


def test_toxicity_scores_equal_the_sum_over_pairs(docs):
    rng = np.random.default_rng(1)
    buckets = sorted({b for r in rows() for w in toxicity.WORD.findall(text_of(r).lower()) for b in toxicity.hashed_terms(w)})
    machine = toxicity.Machine(-0.3, rng.normal(0, 0.1, len(buckets)), rng.normal(0, 0.1, (len(buckets), 8)), {b: i for i, b in enumerate(buckets)})
    want = {}
    for r in rows():
        at = sorted({machine.place[b] for w in toxicity.WORD.findall(text_of(r).lower()) for b in toxicity.hashed_terms(w)})
        total = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[:k])
        want.setdefault(r[0], []).append(round(1 / (1 + math.exp(-total)), 9))
    got: dict = {}
    for r in toxicity.score_documents(docs, machine).collect():
        got.setdefault(r.doc_id, []).append(round(r.score, 9))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


def test_toxicity_of_awkward_rows(spark, docs, empty):
    _, labels = toxic_table(spark, 300)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int"))
    machine = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, machine).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty, machine).count() == 0
    nothing = toxicity.fit(empty, labels.limit(0))
    assert {r.predicted for r in toxicity.score_documents(docs, nothing).collect()} == {0}
    kept = toxicity.drop_toxic(docs, nothing)
    assert kept.schema == docs.schema and kept.count() == len(rows())


# --- 2 token counts


def test_token_counts_equal_the_library(docs, empty, libraries):
    lib = libraries[BYTE]
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect() if r.doc_id is not None)
    want = []
    for r in rows():
        n = len(lib.encode(text_of(r), add_special_tokens=False).ids)
        if r[0] is not None:
            want.append((True, r[0], len(text_of(r).encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "<|endoftext|>", "<|endof", "é", "ß", "漢", "😀", "1", "23", "!", "...", "\xa0", "　", "\x1c", "\x85", "Ⅷ", "²", "Σ", "İ", "ing", "the,\nIn"]


def test_every_prefix_has_its_own_encodings_length(libraries):
    lib, counter, rng = libraries[BYTE], token_counts.counter(BYTE), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12)))
        got = counter.prefix_counts(text)
        want = [len(lib.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
        assert got.tolist() == want and counter.count(text) == want[-1]
        cut = counter.truncate(text, 3)
        assert len(lib.encode(cut, add_special_tokens=False).ids) <= 3
        assert all(w > 3 for w in want[len(cut) :])
        assert counter.first_over(text, 3) == next((k + 1 for k, w in enumerate(want) if w > 3), len(text) + 1)


def test_prefix_and_truncation_tables(docs, libraries):
    short = docs.filter("length(text) < 400")
    for r in token_counts.prefix_token_counts(short, BYTE).collect():
        assert all(b - a <= 8 for a, b in zip(r.prefix_tokens, r.prefix_tokens[1:]))
    for r in token_counts.truncate_to_budget(short, BYTE, 5).collect():
        assert len(libraries[BYTE].encode(r.text, add_special_tokens=False).ids) <= 5


# --- encoding shared by 4 and 5


def test_encoder_equals_the_library(libraries):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += [chr(c) + "a " + chr(c) + "b." for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    for path, lib in libraries.items():
        want = [np.asarray(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoding.encoder(path).encode(texts) == want
        assert encoding.encoder(path).encode(texts[:7]) == want[:7] and encoding.encoder(path).encode([]) == [] and encoding.encoder(path).encode([None, ""]) == [b"", b""]


# --- 3 substring dedup


def passage(seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(55))


def test_repeated_passages_are_found_and_nothing_else(spark):
    shared, own = passage(1), [passage(100 + i) for i in range(12)]
    table = [(i, own[i] + (f" {shared}\n" if i in (2, 5, 9) else " ") + passage(200 + i)) for i in range(12)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    spans = substring_dedup.removed_spans(docs).collect()
    assert {r.doc_id for r in spans} == {5, 9} and {tuple(r.kept_doc_ids) for r in spans} == {(2,)}
    texts = dict(table)
    for r in spans:
        raw = texts[r.doc_id].encode()
        assert raw[r.start : r.start + r.length].decode() == r.text and r.text in texts[2] and r.n_words >= 20
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    for i, text in table:
        assert (left[i] == text) == (i not in (5, 9))
        assert own[i] in left[i]


def test_cuts_resist_shifts():
    text = passage(7) + " " + passage(8)
    a, b = set(substring_dedup.chunks(text)[1].tolist()), set(substring_dedup.chunks("inserted " + text)[1].tolist())
    assert len(a & b) >= len(a) - 3
    ends, digests, words = substring_dedup.chunks(text)
    assert ends[-1] == len(text.encode()) and words.sum() == len(text.split()) and (np.diff(ends) > substring_dedup.REACH).all()
    assert (np.diff(substring_dedup.chunks("z" * 20_000)[0], prepend=0) <= substring_dedup.LONGEST).all()
    brute = [sum(int(substring_dedup.gear()[x]) << k for k, x in enumerate(reversed(b"hello world, hello moon"[max(0, i - 15) : i + 1]))) % 2**64 for i in range(23)]
    assert substring_dedup.rolling(np.frombuffer(b"hello world, hello moon", np.uint8)).tolist() == brute


def brute_spans(table: list[tuple]) -> set:
    """(doc_id, start, length) of repeated runs, chunk by chunk, from all chunks of all documents in one dictionary."""
    holders: dict = {}
    for doc, text in table:
        for k, digest in enumerate(substring_dedup.chunks(text)[1].tolist()):
            holders.setdefault(digest, []).append((doc, k))
    found = set()
    for doc, text in table:
        ends, digests, words = substring_dedup.chunks(text)
        source = [min(holders[d]) if min(holders[d])[0] < doc else None for d in digests.tolist()]
        k = 0
        while k < len(source):
            last = k
            while last + 1 < len(source) and source[k] and source[last + 1]:
                last += 1
            if source[k]:
                follow = [[k]]
                for j in range(k + 1, last + 1):
                    if source[j] == (source[j - 1][0], source[j - 1][1] + 1):
                        follow[-1].append(j)
                    else:
                        follow.append([j])
                if max(int(words[f].sum()) for f in follow) >= substring_dedup.LEAST_WORDS:
                    raw, a, b = text.encode(), int(ends[k - 1]) if k else 0, int(ends[last])
                    white = lambda i: chr(raw[i]).isspace()
                    while 0 < a < b and not white(a) and not white(a - 1):
                        a += 1
                    while a < b < len(raw) and not white(b) and not white(b - 1):
                        b -= 1
                    if b > a:
                        found.add((doc, a, b - a))
            k = last + 1
    return found


def test_removed_spans_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [passage(i) for i in range(8)] + [" ".join(passage(50 + i).split()[:12]) for i in range(8)] + ["| - | " * 60, "na " * 80]
    table = [(i, " ".join(rng.choice([rng.choice(pool), passage(1000 + 20 * i + j)]) for j in range(rng.randrange(1, 6)))) for i in range(60)]
    got = substring_dedup.removed_spans(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.start, r.length) for r in got} == brute_spans(table)
    # Every later copy of a passage of 55 words is found, all but its ends.
    for shared in pool[:8]:
        for doc in [d for d, text in table if shared in text][1:]:
            at = len(dict(table)[doc].split(shared)[0].encode())
            covered = sum(max(0, min(r.start + r.length, at + len(shared)) - max(r.start, at)) for r in got if r.doc_id == doc)
            assert covered >= 0.5 * len(shared), (doc, covered)
    # Passages that repeat with a short period are found too, whatever stands around them.
    assert any("| - | - |" in r.text.replace("| |", "|") or "| - | | - |" in r.text for r in got) and any("na na na" in r.text for r in got)


def test_phrases_of_several_documents_are_no_passage(spark):
    """Chunks that earlier documents hold one by one, not one after another, stay."""
    parts = [passage(i) for i in range(6)]
    cut = substring_dedup.chunks(" ".join(parts))
    raw, edges = " ".join(parts).encode(), [0, *cut[0].tolist()]
    pieces = [raw[a:b].decode() for a, b in zip(edges, edges[1:])]
    mixed = "".join(pieces[::2])
    table = [(0, " ".join(parts)), (1, mixed)]
    assert substring_dedup.removed_spans(spark.createDataFrame(table, "doc_id long, text string")).count() == 0


def test_substring_dedup_of_awkward_rows(docs, empty):
    assert substring_dedup.removed_spans(empty).count() == 0 == substring_dedup.remove_repeats(empty).count()
    spans = substring_dedup.removed_spans(docs).collect()
    assert {(r.doc_id, tuple(r.kept_doc_ids)) for r in spans} >= {(5, (4,)), (7, (6,))}
    assert 2 not in {r.doc_id for r in spans}
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows())
    assert left.filter("doc_id = 24").first().text is None


# --- 4 token files


def test_token_files_round_trip(spark, docs, empty, libraries):
    import pyarrow.parquet as pq

    path = scratch_path(spark, "test-token-files")
    again = docs.union(docs.filter("doc_id = 3").withColumn("text", F.lit("the same id, another text")))
    token_files.write_token_files(again, BYTE, path)
    texts: dict = {}
    for r in again.collect():
        ids = np.array([*libraries[BYTE].encode(text_of(r), add_special_tokens=False).ids, 0], "<u4")
        texts.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda d: (d is not None, d))
    at = 0
    for doc, start, n, crc in got:
        assert start == at
        texts[doc].remove((n, crc))
        at += n
    assert not any(texts.values())
    files = sorted(Path(path.removeprefix("file:")).glob("*.parquet"), key=lambda f: int(re.search(r"part-(\d+)", f.name)[1]))
    stream = [i for f in files for ids in pq.read_table(f).column("ids").to_pylist() for i in ids]
    assert all(zlib.crc32(np.array(stream[s : s + n], "<u4").tobytes()) == crc for _, s, n, crc in got)
    assert {r.doc_id: len(r.ids) for r in token_files.read_tokens(spark, path, [4, 5, 999]).collect()} == {d: n for d, _, n, _ in got if d in (4, 5)}
    assert token_files.read_metadata(spark, path).columns == ["doc_id", "n_tokens"] and token_files.read_tokens(spark, path, []).count() == 0
    file = pq.ParquetFile(sorted(Path(path.removeprefix("file:")).glob("*.parquet"))[0])
    encodings = file.metadata.row_group(0).column(0).encodings
    assert "DELTA_BINARY_PACKED" in encodings or "RLE_DICTIONARY" in encodings
    assert file.metadata.row_group(0).column(0).has_column_index
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(empty, BYTE, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_selective_reads_skip_pages(spark):
    """Of 40,000 documents in one file, a read of three fetches the rows of a few pages."""
    path = scratch_path(spark, "test-token-files")
    table = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_files._encode(table.coalesce(1).sortWithinPartitions("doc_id"), BYTE, 0).write.options(**token_files.LAYOUT).parquet(path)
    asked = token_files.read_tokens(spark, path, [20_000, 20_001, 20_002])
    assert len(asked.collect()) == 3
    plan = asked._jdf.queryExecution().executedPlan()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    assert "In(doc_id" in scan.toString() and scan.metrics().apply("numOutputRows").value() <= 4_000


# --- 5 packing


def check_packed(packed, sources, lib, capacity):
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array([*lib.encode(sources[doc], add_special_tokens=False).ids, 2], "<u4")
        copies = Counter(p.start for p in pieces)[0]
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    return [sum(p.length for p in pieces) for pieces in by_sequence.values()]


def test_packing_is_whole_and_tight(docs, empty, libraries):
    packed = packing.pack_documents(docs, WORD, 512).collect()
    lengths = check_packed(packed, {r[0]: text_of(r) for r in rows()}, libraries[WORD], 512)
    assert {p.doc_id for p in packed} == {r[0] for r in rows()}
    assert sum(packing.padding_of(n, 512) for n in lengths) < 0.06 * sum(lengths)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_differencing(monkeypatch):
    rng = random.Random(0)
    for windows in (1, 2, 5, 9):
        sizes = [rng.randrange(0, 300) for _ in range(60)]
        dealt, heaviest = packing.difference(sizes, windows)
        assert sorted(i for w in dealt for i in w) == list(range(60)) and heaviest == max(sum(sizes[i] for i in w) for w in dealt)
        assert heaviest - sum(sizes) / windows < 40
    assert packing.difference([8, 7, 6, 5, 4], 2)[1] == 16
    packed = packing.pack([60, 60, 60], 100)
    assert len(packed) == 3
    assert packing.pack([], 100) == [] and packing.cuts(0, 10) == [(0, 0)] and packing.cuts(25, 10) == [(0, 8), (8, 8), (16, 9)]


# --- 6 html


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- c --><header><p>Site</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text.<br>Broken
    line <p>Unclosed &lt;tag&gt; <script>var x="</p>";</script> tail</p></article><div id="comments"><p>Nice!</p></div><aside>Ad</aside><form><input><p>Mail</p></form><footer>F</footer>"""
    assert html_text.main_text(page) == "Head & line First bold text. Broken line Unclosed <tag> tail"
    plain = "<body><div><a href=1>one</a> <a href=2>two</a></div><div>" + "".join(f"<p>{prose(i, 20)}</p>" for i in range(3)) + "</div><div class=sidebar><p>side</p></div><div class='footer'>foot</div>"
    assert html_text.main_text(plain) == " ".join(prose(i, 20) for i in range(3))
    table = [(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "no markup"), (4, "u", "no markup"), (5, "u", "<p>" * 3000), (6, "u", "<a " * 5000), (7, "u", "<div>" * 2000 + "deep" + "</div>" * 10)]
    got = html_text.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    found = [(r.page_id, r.text, r.n_chars) for r in got.collect()]
    assert len(found) == 8 and all(n == len(t) for _, t, n in found)
    assert {(2, "", 0), (None, "", 0), (4, "no markup", 9), (7, "deep", 4)} <= set(found)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_names_are_evidence_only():
    """Elements that hold most of the text are kept whatever they are called; headlines in header elements and tagless pages too."""
    body = "".join(f"<p>{prose(i, 25)}</p>" for i in range(4))
    text = " ".join(prose(i, 25) for i in range(4))
    side = "<div class=sidebar><p>Side text here</p></div><footer><p>Foot</p></footer>"
    for page in (
        f'<body><main class="page with-sidebar">{body}</main>{side}</body>',
        f'<body><div class="content has-sidebar">{body}</div>{side}</body>',
        f'<body><div class="widget-page">{body}</div>{side}</body>',
        f"<body><form>{body}</form></body>",
        f"<body><article><p>{prose(50, 3)}</p></article><div>{body}</div>{side}</body>",
    ):
        assert text in html_text.main_text(page) and "Side" not in html_text.main_text(page) and "Foot" not in html_text.main_text(page), page[:60]
    page = f'<body><article><div class="entry-header"><h1>Head line</h1></div>{body}<p>Last.</p></article>{side}</body>'
    assert html_text.main_text(page) == f"Head line {text} Last."
    tagless = f"<a href=1>one</a><br><a href=2>two</a><br>{'<br>'.join(prose(i, 25) for i in range(4))}<br><br><br><br><a href=3>three</a>"
    assert html_text.main_text(tagless) == text


def brute_main_text(page: str) -> str:
    """Window by window over the page's weighed lines."""
    lines = html_text.lines_of(page)
    inside, weighed = sum(len(x.text) for x in lines if x.article), sum(len(x.text) for x in lines if not x.dropped)
    trusted = inside > 0 and inside >= html_text.FAIR * weighed
    weight = [0 if x.dropped or trusted and not x.article or not trusted and x.linked and x.linked >= html_text.LINK_SHARE * len(x.text) else len(x.text) for x in lines]
    regions, k = [], 0
    for k in range(len(lines)):
        window = sum(weight[k : k + html_text.WINDOW])
        if window and regions and regions[-1][-1] == k - 1:
            regions[-1].append(k)
        elif window:
            regions.append([k])
    text = [[lines[k].text for k in r if weight[k]] for r in regions]
    kept = [t for r, t in zip(regions, text) if any(sum(weight[k : k + html_text.WINDOW]) >= html_text.SURGE or trusted and lines[k].article for k in r)]
    return " ".join(w for t in kept for w in t) if kept else " ".join(max(text, key=lambda t: sum(map(len, t)), default=[]))


def test_html_equals_brute_force(spark, data):
    pages = [r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").limit(200).collect()]
    assert [html_text.main_text(p) for p in pages] == [brute_main_text(p) for p in pages]


# --- 7 media


def test_media_round_trip_of_awkward_rows(docs, empty):
    got = {}
    for r in media_jpeg.round_trip(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for row in rows():
        raw = text_of(row).encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        for r in got[row[0]]:
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            media = media_jpeg.encode(payload)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[4][0].feature == got[5][0].feature and got[24][0].feature == got[25][0].feature
    assert media_jpeg.round_trip(empty).count() == 0


def test_fast_reading_equals_bit_by_bit():
    rng = np.random.default_rng(0)
    for n in (192, 384, 576, 4032):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        media = media_jpeg.encode(payload)
        fast, slow = media_jpeg.read(media), media_jpeg.read(media, fast=False)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components))
        assert media_jpeg.payload_of(fast) == payload


def test_against_the_runtimes_codec(spark):
    """Progressive files of another writer are read, and another reader reads ours."""
    jvm = spark.sparkContext._jvm
    io = jvm.javax.imageio.ImageIO
    media = media_jpeg.encode(bytes([128 + i % 3 for i in range(1152)]))
    image = io.read(jvm.java.io.ByteArrayInputStream(media))
    assert (image.getHeight(), image.getWidth()) == media_jpeg.rgb(media_jpeg.read(media)).shape[:2]
    made = jvm.java.awt.image.BufferedImage(45, 37, 1)
    for y in range(37):
        for x in range(45):
            made.setRGB(x, y, (x * 5 % 256) << 16 | (y * 6 % 256) << 8 | x * y // 8 % 256)
    writer = io.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    options.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = io.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(made, None, None), options)
    stream.flush()
    data = bytes(out.toByteArray())
    assert data.count(b"\xff\xda") > 5
    mine, theirs = media_jpeg.rgb(media_jpeg.read(data)).astype(int), io.read(jvm.java.io.ByteArrayInputStream(data))
    pixels = np.array([[theirs.getRGB(x, y) for x in range(45)] for y in range(37)], np.int64)
    other = np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], 2)
    assert np.abs(mine - other).mean() < 2
    tensors = media_jpeg.decode_media(spark.createDataFrame([(1, data), (2, None), (3, b"junk")], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (tensors[0].height, tensors[0].width, len(tensors[0].rgb)) == (37, 45, 37 * 45 * 3) and tensors[1].rgb is None and tensors[2].rgb is None


# --- 8 mixing


def water_filling(sizes: dict, repeats: int = 3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while free:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = repeats * sizes[s]
            free.discard(s)
    return target


def test_mixing_meets_targets(spark, docs, empty):
    table = [*rows(), *[(1000 + i, prose(i, 400), None, "zz", None, None, None, None, None, None) for i in range(40)], (2000, "tiny one", None, "a", None, None, None, None, None, None)]
    mixed = mixing.mix(spark.createDataFrame(table, SCHEMA)).collect()
    sizes: dict = {}
    for r in table:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text_of(r)))
    want = water_filling(sizes)
    assert len(mixed) == len(table)
    taken: dict = {}
    for r in mixed:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(spark.createDataFrame(table[::-1], SCHEMA)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0
    ordered = [r.position for r in mixing.training_order(mixing.mix(docs), 3).collect() if r.position is not None]
    assert ordered == sorted(ordered)


def test_mixing_repeats_documents(spark, docs, empty):
    small = docs.filter("doc_id < 24").dropDuplicates(["doc_id"])
    made = mixing.repeat_documents(small, 2)
    taken = {r.doc_id: r.taken for r in mixing.mix(small).collect()}
    texts = {r[0]: r[1] for r in rows()}
    words: dict = {}
    for r in made.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert made.columns == docs.columns and words == {d: n for d, n in taken.items() if n}
    assert mixing.repeat_documents(empty, 2).count() == 0 and mixing.repeat_documents(docs, 2).count() > 0


def test_mixing_places_every_copy_on_the_schedule(spark):
    """A source that is taken three times is spread over the whole training, not over its end."""
    table = [(d, "a" if d >= 400 else "b", f"w{d} x y z") for d in range(440)]
    small = spark.createDataFrame(table, "doc_id long, source string, text string")
    order = [r.doc_id for r in mixing.repeat_documents(small, 1).collect()]
    seen = [i / len(order) for i, d in enumerate(order) if d >= 400]
    assert len(seen) == 120 and min(seen) < 0.1 and max(seen) > 0.9
    thirds = [sum(a <= x < a + 1 / 3 for x in seen) for a in (0, 1 / 3, 2 / 3)]
    assert min(thirds) > 20
    place = {(r.doc_id, r.source): r for r in mixing.mix(small, key=True).collect()}
    want = []
    for r in place.values():
        copies = -(-r.taken // r.size)
        for k in range(copies):
            share = min(1, (r.start + k * r.source_size) / r.goal)
            bend = r.slope - 1
            t = share if bend == 0 else abs((math.sqrt(1 + 2 * bend * share * (1 + bend / 2)) - 1) / bend)
            want.append((round(t, 9), r.doc_id))
    assert order == [d for _, d in sorted(want)]


def test_schedules_invert():
    share = np.linspace(0, 1, 11)
    for slope in (2.0, 0.5):
        whole = 1 + (slope - 1) / 2
        t = (np.sqrt(1 + 2 * (slope - 1) * share * whole) - 1) / (slope - 1)
        assert np.allclose((t + (slope - 1) * t * t / 2) / whole, share)


# --- 9 simhash


def brute_fingerprint(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(docs, empty):
    prints = [(r[0], brute_fingerprint(text_of(r))) for r in rows()]
    parent = dict(enumerate(range(len(prints))))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    want = Counter((doc, f"{p:016x}", least.get(root(i))) for i, (doc, p) in enumerate(prints))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_multi_index_finds_every_close_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for x in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    pairs = {tuple(sorted(r)) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert pairs == {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if 0 < ((a ^ b) & mask).bit_count() <= 3}
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}, 501: 500}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_edges_are_contracted_at_once(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(6000)], "u long, v long").repartition(7)
    wanted = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert {r.node: r.root for r in components.connected_components(edges, 10_000).collect()} == wanted and wanted[7000] == 1000
    assert components.connected_components(edges.limit(0), 10).count() == 0


def shingles(text: str, n: int = 5) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def test_near_copies_go_and_others_stay(spark, docs, empty):
    rng, table = random.Random(8), []
    for g in range(15):
        words = [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(300)]
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            table.append((g * 10 + k, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_first_of_group(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert kept == {g * 10 for g in range(15)}
    a, b = table[0][1], table[3][1]
    assert len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8
    left = simhash.keep_first_of_group(docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and 4 in ids and 5 not in ids and ids.count(2) == 1 and None in ids and {8, 9, 10, 30} <= set(ids)
    assert simhash.keep_first_of_group(empty).count() == 0


def test_near_copies_equal_brute_force(spark):
    """Appended, truncated, block-edited and scattered copies at similarity 0.8 and more: every one is found, and no other."""
    rng, table = random.Random(4), []
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(3000)}" for _ in range(n)]
    for g in range(60):
        words = fresh(rng.randrange(60, 400))
        n, cut = len(words), rng.randrange(2, 12)
        part = n * cut // 50
        at = rng.randrange(n - part)
        scattered = list(words)
        for _ in range(max(1, n // 60)):
            scattered[rng.randrange(n)] = fresh(1)[0]
        for k, copy in enumerate((words, words + fresh(part), words[: n - part], words[:at] + fresh(part) + words[at + part :], scattered)):
            table.append((g * 10 + k, " ".join(copy)))
    sets = {d: shingles(t) for d, t in table}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in range(a // 10 * 10, a):
            if b in sets and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = {r.doc_id: r.group_id for r in simhash.near_copy_groups(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in sets} and len(set(got.values())) > 60


def test_near_copies_beside_unlike_leaders(spark, monkeypatch):
    """Two near copies whose shingles are shared with many unlike documents are compared with each other as well."""
    monkeypatch.setattr(simhash, "FREQUENT_DOCS", 10**9)
    monkeypatch.setattr(simhash, "POSTINGS_BLOCK", 5)
    rng, table = random.Random(6), []
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    for g in range(8):
        words = fresh(200)
        others = [words[:100] + fresh(100) for _ in range(15)] + [fresh(100) + words[100:] for _ in range(15)]
        for k, copy in enumerate([words, words + fresh(4), *others]):
            table.append((g * 100 + k, " ".join(copy)))
    got = {r.doc_id: r.group_id for r in simhash.near_copy_groups(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {d: d - 1 if d % 100 == 1 else d for d, _ in table}


def test_near_copies_start_from_fingerprints(spark, monkeypatch):
    """Multi-index hashing gives the first candidates: every two classes within three bits are linked over them."""
    rng, table = random.Random(12), []
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(3000)}" for _ in range(n)]
    for g in range(25):
        words = fresh(900)
        table += [(g * 10 + k, " ".join(words + fresh(2 * k))) for k in range(4)]
    table += [(900, ""), (901, None)]
    asked, close = [], simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda distinct, *more: asked.append(distinct.count()) or close(distinct, *more))
    frame = spark.createDataFrame(table, "doc_id long, text string")
    found = {(r.same, r.n, r.fp) for r in simhash.prefixes(frame, 5, 0.8).collect()}
    marks = spark.createDataFrame(sorted(found), "same long, n int, fp long")
    near = {(r.u, r.v) for r in simhash._fingerprint_pairs(marks).collect()}
    parts = dict(components.forest(sorted(near)))
    full = [x for x in sorted(found) if x[1]]
    within = [(a[0], b[0]) for i, a in enumerate(full) for b in full[:i] if ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= 3]
    assert len(within) > 25 and all(parts.get(a, a) == parts.get(b, b) for a, b in within)
    got = {r.doc_id: r.group_id for r in simhash.near_copy_groups(frame).collect()}
    assert got == {d: 900 if d >= 900 else d - d % 10 for d, _ in table} and len(asked) == 2 and min(asked) > 25


def test_shingles_are_ordered_by_all_documents(spark):
    """A shingle of a few documents is frequent however many other documents there are."""
    text = F.when(F.col("id") % 5000 == 7, "one two three four five").otherwise(F.concat(F.lit("doc "), F.col("id").cast("string")))
    found, often = simhash._frequent(spark.range(20_000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text")), 5)
    assert found.tolist() == simhash.shingle_hashes("one two three four five", 5) and often.tolist() == [4]
    found, often = simhash._frequent(spark.createDataFrame([], "doc_id long, text string"), 5)
    assert not len(found) and not len(often)


def test_unlike_long_texts_with_a_common_passage_are_no_candidates(spark, monkeypatch):
    """What shares too few prefix shingles is no candidate, though its sketches are saturated; every similar pair is one."""
    monkeypatch.setattr(simhash, "FREQUENT_DOCS", 10**9)
    rng, table = random.Random(15), []
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    for g in range(12):
        words = fresh(300) + passage + fresh(300)
        for k, copy in enumerate((words, words + fresh(20), words[:-80], words[60:] + fresh(70))):
            table.append((g * 10 + k, " ".join(copy)))
    found = simhash.prefixes(spark.createDataFrame(table, "doc_id long, text string"), 5, 0.8)
    ids = {r.same: r.doc_id for r in found.collect()}
    rows = found.select("same", "n", *simhash.SKETCHES, F.col("same").alias("component"), F.posexplode("prefix").alias("place", "key"))
    got = [tuple(sorted((ids[r.u], ids[r.v]))) for r in simhash._all_pairs(simhash._open(rows), 0.8).collect()]
    sets = {d: shingles(t) for d, t in table}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and alike <= set(got) and len(alike) > 30 and all(a // 10 == b // 10 for a, b in got)


def test_versions_a_little_apart_are_no_candidates(spark, monkeypatch):
    """Versions of a text somewhat under the similarity make few pairs, though they share most prefix shingles; near copies are all found."""
    rng, table = random.Random(21), []
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    for g in range(5):
        words = fresh(300)
        for k in range(16):
            version = words[: k * 18] + fresh(17) + words[k * 18 + 17 :]
            table += [(g * 100 + 2 * k, " ".join(version)), (g * 100 + 2 * k + 1, " ".join(version + fresh(3)))]
    asked, pairs = [], simhash._all_pairs

    def counted(*given):
        found = pairs(*given)
        asked.append(found.count())
        return found

    monkeypatch.setattr(simhash, "_all_pairs", counted)
    got = {r.doc_id: r.group_id for r in simhash.near_copy_groups(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in table} and len(asked) == 1 and asked[0] < 250


def test_common_prefix_shingles_are_counted_by_runs(spark):
    """Runs that begin and end in one row, in several rows and at the ends of postings: pairs with enough common shingles, and no others."""
    rng, table = random.Random(22), []
    for same in range(1, 120):
        n = rng.randrange(20, 31)
        shared = sorted(rng.sample(range(12), rng.randrange(1, 7)))
        place = sorted(rng.sample(range(simhash.prefix_length(n, 0.6)), len(shared)))
        table += [(same, n, same, p, key) + (0,) * len(simhash.SKETCHES) for p, key in zip(place, shared)]
    names = ", ".join(f"{x} long" for x in ("same", "n", "component", "place", "key", *simhash.SKETCHES))
    got = {(r.u, r.v): r.total for r in simhash._all_pairs(simhash._open(spark.createDataFrame(table, names)), 0.6).collect()}
    keys, sizes, want = {}, {}, {}
    for same, n, _, _, key, *_ in table:
        keys.setdefault(same, set()).add(key)
        sizes[same] = n
    for u in keys:
        for v in range(u + 1, 120):
            n = sizes[u], sizes[v]
            rest = math.ceil(0.6 * max(n) - 1e-9) - 1
            if keys[u] & keys[v] and (len(keys[u] & keys[v]) + rest) * 1.6 >= 0.6 * sum(n) - 1e-6:
                want[u, v] = sum(n)
    assert set(got.items()) <= set(want.items()) and len(want) > 100
    # Places may rule out more; where they can't, every pair is there.
    spots = {(same, key): place for same, _, _, place, key, *_ in table}
    free = {(u, v) for u, v in want if all((min(len([k for k in keys[x] if k < key]) for x in (u, v)) + min(sizes[x] - spots[x, key] for x in (u, v))) * 1.6 >= 0.6 * want[u, v] - 1e-6 for key in keys[u] & keys[v])}
    assert free <= set(got) and len(free) > 50


def test_texts_are_packed_in_small_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 60, None, "", "b" * 60, "c" * 300, "d"])], names=["doc_id", "text"])
    parts = list(packing.parts_of(batch, 100))
    assert pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch) and [p.num_rows for p in parts] == [3, 1, 2]
    assert list(packing.parts_of(batch.slice(0, 0), 100)) == []


# --- 10 search


def brute_search(table, queries, k):
    tf = [(d, Counter(re.findall(r"\w+", t.lower()))) for d, t in table if d is not None]
    df = Counter(w for _, c in tf for w in c)
    n, mean = len(tf), sum(sum(c.values()) for _, c in tf) / len(tf)
    out = {}
    for q, text in queries:
        asked = Counter(re.findall(r"\w+", text.lower()))
        found = []
        for d, c in tf:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, m in asked.items() if w in c)
            if s > 0:
                found.append((-round(s, 9), d))
        out[q] = [d for _, d in sorted(found)[:k]]
    return out


def test_search_equals_brute_force(spark, docs, empty, monkeypatch):
    table = [(r[0], text_of(r)) for r in rows()]
    want = brute_search(table, [(d, t) for d, t in table if d is not None and d % 3 == 0], 6)
    for shard, block, sent in ((12_000, 64, 32 << 20), (7, 2, 2_000)):
        monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
        monkeypatch.setattr(bm25, "BLOCK", block)
        monkeypatch.setattr(bm25, "QUERY_BYTES", sent)
        found: dict = {}
        for r in bm25.search(docs, docs.filter("doc_id % 3 = 0"), 6).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.doc_id)
        assert {q: d for q, d in found.items()} == {q: d for q, d in want.items() if d}
    assert bm25.search(empty, docs.filter("doc_id % 3 = 0"), 6).count() == 0
    assert bm25.search(docs, empty, 6).count() == 0


def test_pruned_search_equals_full_scores():
    rng = np.random.default_rng(0)
    n, terms = 900, np.arange(40)
    counts = rng.poisson(0.4, (n, 40))
    doc, term = np.nonzero(counts)
    order = np.lexsort((doc, term))
    places, tf = doc[order], counts[doc[order], term[order]]
    ends = np.searchsorted(term[order], terms, side="right")
    lengths = counts.sum(1)
    shard = bm25.Shard(np.arange(n), lengths, terms, ends, places, tf, lengths.mean())
    norm = 1.2 * (0.25 + 0.75 * lengths / lengths.mean())
    gains = counts * 2.2 / (counts + norm[:, None])
    asked = bm25.Queries.of([(q, np.sort(rng.choice(40, 5, replace=False)), rng.random(5) + 0.1) for q in range(20)])
    begins = [0, *asked.ends[:-1].tolist()]
    best = []
    for a, b in zip(begins, asked.ends.tolist()):
        full = np.round(gains[:, asked.terms[asked.which[a:b]]] @ asked.weights[a:b], 9)
        best.append([(d, full[d]) for d in np.lexsort((np.arange(n), -full))[:10].tolist()])
    known = np.array([scores[-1][1] for scores in best])
    for least in (np.full(20, -np.inf), known.copy(), known - 0.3):
        at, docs, scores = shard.search(asked, least, 10)
        for q in range(20):
            assert docs[at == q].tolist() == [d for d, _ in best[q]] and np.allclose(scores[at == q], [x for _, x in best[q]])
        assert np.allclose(least, known)
    # A threshold that nothing reaches keeps the shard from being entered; queries that are not chosen are not answered.
    assert not len(shard.search(asked, np.full(20, 1e6), 10)[0])
    assert set(shard.search(asked, np.full(20, -np.inf), 10, np.arange(20) < 3)[0].tolist()) == {0, 1, 2}


def test_terms_equal_brute_force():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice([*PIECES, "_x", "Word,", "ÀÉ's"]) for _ in range(rng.randrange(0, 14))) for _ in range(500)] + [None, ""]
    ends, terms, counts = bm25.term_counts(pa.array(texts))
    for text, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
        want = Counter(re.findall(r"\w+", (text or "").lower()))
        got = dict(zip(terms[a:b].tolist(), counts[a:b].tolist()))
        assert got == {int(bm25._terms([w])[0]): n for w, n in want.items()} and terms[a:b].tolist() == sorted(got)


# --- registration and pipeline


def test_registered_queries(spark, data):
    import __spark_entry__ as entry

    assert [n for n in entry.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    small = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_token_counts", "op7_media_jpeg", "op8_mixing", "op9_simhash", "op4_token_files"):
        assert entry.queries()[name](spark, data).count() == small


def test_chosen_queries_are_asked_with_their_own_terms(monkeypatch):
    """A shard that is asked for some queries looks up no terms of others, and finds what it finds for all."""
    rng = np.random.default_rng(5)
    rows = [(q, np.unique(rng.integers(0, 400, 12)), None) for q in range(50)]
    asked = bm25.Queries.of([(q, t, rng.random(len(t))) for q, t, _ in rows])
    terms = np.arange(0, 400, 2)
    places = np.concatenate([np.sort(rng.choice(90, 6, replace=False)) for _ in terms])
    shard = bm25.Shard(np.arange(90), np.full(90, 20), terms, np.arange(1, len(terms) + 1) * 6, places, rng.integers(1, 4, len(places)), 20.0)
    every, least = np.full(50, -np.inf), np.full(50, -np.inf)
    whole = list(zip(*(x.tolist() for x in shard.search(asked, every, 4)), strict=True))
    seen, batch = [], bm25.Shard._batch
    monkeypatch.setattr(bm25.Shard, "_batch", lambda self, queries, *more: seen.append(len(queries.ids)) or batch(self, queries, *more))
    chosen = np.isin(np.arange(50), (3, 17, 41))
    part = list(zip(*(x.tolist() for x in shard.search(asked, least, 4, chosen)), strict=True))
    assert part and sorted(part) == sorted(x for x in whole if x[0] in (3, 17, 41)) and seen == [3]
    assert np.array_equal(least[chosen], every[chosen]) and np.isinf(least[~chosen]).all()


def test_pipeline_stages(spark, data, libraries):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = scratch_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns and set(after.doc_id) <= set(before.doc_id)
        if name == "toxicity":
            gone = set(before.doc_id) - set(after.doc_id)
            assert not [d for d in gone & set(labels.index) if not labels.toxic[d]]
        elif name == "near_copies":
            sets = {r.doc_id: shingles(r.text) for r in before.itertuples()}
            kept, gone = list(after.doc_id), set(before.doc_id) - set(after.doc_id)
            alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert all(max(alike(d, o) for o in sets if o != d) >= 0.7 for d in gone)
            assert sum(alike(a, b) >= 0.8 for i, a in enumerate(kept) for b in kept[:i]) <= 1
        elif name == "repeated_passages":
            assert len(after) == len(before) and after.text.str.len().sum() <= before.text.str.len().sum()
        elif name == "mixing":
            sizes = before.assign(n=before.text.str.split().str.len()).groupby("source").n.sum().to_dict()
            got = after.assign(n=after.text.str.split().str.len()).groupby("source").n.sum().to_dict()
            assert all(abs(got.get(s, 0) - t) <= 1 for s, t in water_filling(sizes).items())
        else:
            lengths = check_packed([r for r in docs.collect()], dict(zip(before.doc_id, before.text)), libraries[WORD], 4096) if before.doc_id.is_unique else after.groupby("sequence_id").length.sum().tolist()
            assert max(lengths) <= 4096
        before = after


def test_a_worker_that_has_packed_gives_its_memory_back(monkeypatch):
    """Workers live on beside the next stage's: of 10 MB of text little stays with one that has packed it."""
    import pyarrow as pa

    from gridloom.llm import packing
    from gridloom.llm.common import give_back
    from gridloom.llm.encoding import encoder
    from gridloom.llm.queries import WORD_VOCABULARY, vocabulary

    class Documents:
        sparkSession = schema = dataType = None
        mapInArrow = staticmethod(lambda run, schema: run)

        def __getitem__(self, name):
            return self

        simpleString = staticmethod(lambda: "bigint")

    documents = Documents()
    documents.schema, documents.dataType = documents, documents
    monkeypatch.setattr(packing, "doc_and_text", lambda x: x)
    monkeypatch.setattr(packing, "small_batches", lambda x: None)
    path = vocabulary(WORD_VOCABULARY)
    run = packing.pack_documents(documents, path)

    def resident():
        give_back()
        return now()

    def now():
        with open("/proc/self/status") as file:
            return int(next(x for x in file if x.startswith("RssAnon")).split()[1]) / 1024

    words = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(100_000, 120_000)]

    def batches():
        rng = np.random.default_rng(5)
        for k in range(2):
            texts = [" ".join(words[i] for i in rng.integers(0, len(words), 1000).tolist()) for _ in range(700)]
            yield pa.RecordBatch.from_arrays([pa.array(range(700 * k, 700 * k + 700)), pa.array(texts)], names=["doc_id", "text"])

    encoder(path).arrays(pa.array(words))
    before = resident()
    made = [x for batch in run(batches()) for x in batch.column(0).to_pylist()]
    assert set(made) == set(range(1400))
    del made
    # What the generator of texts leaves is no part of it: Python's own lists are small beside what is encoded.
    assert now() - before < 30
