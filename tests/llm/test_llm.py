"""Operators for training data: brute-force versions, edge cases and planted rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from check_oracle import canonical

import corpus_pipeline
from volpanel.llm import queries as Q
from volpanel.llm.archives import LoserTree, archive
from volpanel.llm.conversations import collapse_snapshots
from volpanel.llm.decontamination import decontaminate
from volpanel.llm.licences import NOTICES, scan_licences, telling
from volpanel.llm.main_text import extract_text, main_text, minimum_cut
from volpanel.llm.near_duplicates import near_duplicates, similarity, sketches
from volpanel.llm.packing import closest, pack, plan_windows
from volpanel.llm.personal_data import BASE, SEED, find_personal_data, redacted, reliabilities
from volpanel.llm.quality import log_tail, quality_rules
from volpanel.llm.tokens import Encoder
from volpanel.llm.toxicity import Decoder, log_probabilities, score_toxicity, trigram_counts

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id").sort_index()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, equal and repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, long), (4, long), (5, "one"), (5, "one"), (None, "one two three four five six"), (6, "ONE"), (7, None)]
    rows = [(i, t, "x", None, 1, 2, "y", [1], "z") for i, t in texts]
    schema = "doc_id long, text string, id string, node string, n int, first int, block string, spans array<int>, stratum string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_every_operator_takes_odd_and_empty_tables(spark, odd, labels):
    tests = spark.createDataFrame([(1, "one"), (2, None), (3, "w1 w2 w3"), (None, "x")], "item_id long, text string")
    runs = [
        lambda d: decontaminate(d, tests),
        lambda d: decontaminate(d, tests.limit(0)),
        scan_licences,
        lambda d: quality_rules(d, labels, stratum="source" if "source" in d.columns else "id"),
        lambda d: score_toxicity(d, labels),
        lambda d: score_toxicity(d, labels.limit(0)),
        near_duplicates,
        find_personal_data,
    ]
    for run in runs:
        assert run(odd).count() == odd.count()
        assert run(odd.limit(0)).count() == 0
    path = Q.tokenizer_path()
    assert pack(odd, path).selectExpr("sum(doc_tokens) OVER () > 0 AS x", "doc_id").count() >= odd.count()
    assert pack(odd.limit(0), path).count() == 0


def test_index_finds_windows_and_near_windows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    near = passage.replace("p4 ", "p4 extra ").replace("p9 ", "other ")
    docs = [(1, "a b " + passage + " c"), (2, near), (3, "nothing here"), (4, None), (5, "Short Item, here"), (6, " ".join(["z"] * 400) + " " + passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([("x", passage), ("y", "short item"), ("z", None)], "item_id string, text string")
    for size in (1_000_000, 5):  # one set of test words, and several
        found = by_id(decontaminate(frame, tests, test_words=size))
        assert (found[1].n_words, found[1].n_hit, found[1]["items"], found[1].contaminated) == (23, 20, ["x"], True)
        assert found[2].n_hit == 0 and found[2].near_items == ["x"]
        assert (found[5].n_hit, found[5]["items"]) == (2, ["y"])
        assert found[6].n_hit == 20 and not found[6].contaminated
        assert found[3].n_hit == found[4].n_hit == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert canonical(Q.queries()[name](spark, FOLDER).toPandas()) == canonical(con.execute(Q.oracle_sql()[name]).df())


def test_snapshots_collapse_into_the_longest(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", None), ("assistant", "d")]
    rows = [(c, i, *t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for i, t in enumerate(talk[:n])]
    rows += [(6, 0, "user", "a"), (6, 1, "assistant", "x"), (7, 0, "user", "a"), (7, 5, "assistant", "b"), (8, 0, "user", None), (9, 0, "user", "")]
    got = by_id(collapse_snapshots(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")), "conv_id")
    assert {k: (r.kept, r.kept_by) for k, r in got.items()} == {
        1: (False, 2), 2: (True, None), 3: (False, 2), 4: (False, 2), 5: (False, 2), 6: (True, None), 7: (False, 2), 8: (True, None), 9: (True, None),
    }
    assert got[6].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nx\n<|end|>" and got[1].rendered is None


def test_main_text_of_pages(spark):
    page = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1><a href=/>home</a></header><div class='cookie-notice'>We use cookies, accept them?</div>"
        "<div id=sidebar><ul><li><a>One</a><li><a>Two</a></ul></div><div class=content><h2>Head &amp; line</h2><p>First para with <b>bo</b>ld text, more than some "
        "words here to be long enough.<p>Second.<form><input><label>Mail</label></form></p><div class=comments><p>Great article, I have read it twice today.</p>"
        "</div></div><footer>(c)</footer><script>if(a<b)'</p>'</script></body>"
    )
    assert extract_text(page) == "Head & line First para with bold text, more than some words here to be long enough. Second."
    for broken in ("", "<", "<a", "<p class=\"x>", "<" * 500, "<script>", "&#xZZ;", "<!--"):
        extract_text(broken)
    rows = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (2, "u", "", 0)], "page_id int, url string, html string, text int")
    got = main_text(rows).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(extract_text(page))), (2, 0), (2, 0)]


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(keep):
            return sum(sink[i] if keep >> i & 1 else source[i] for i in range(n)) + sum(w for a, b, w in edges if (keep >> a ^ keep >> b) & 1)

        keep = sum(x << i for i, x in enumerate(minimum_cut(source, sink, edges)))
        assert cost(keep) == pytest.approx(min(map(cost, range(1 << n))))


def test_licences_exact_and_with_edits(spark, real):
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    for i, r in by_id(Q.op4_licences(spark, FOLDER)).items():
        w = words(real.text[i])
        found = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        places = [k for k, _ in found]
        expected = (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected
    texts = [(1, "Licensd under the GNU Generl Public License, version 3"), (2, "CC-BY-NC cc by nc"), (3, "Released undr the MIT licence! All rights reservd"), (4, "all")]
    got = by_id(scan_licences(spark.createDataFrame(texts, "doc_id int, text string")))
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["gpl-3", "cc-by-nc", "all-rights-reserved,mit", ""]
    assert got[2].n_base == 2 and got[1].matches[0].edits == 2 and got[4].score == 0


def test_clipped_notice_is_found_in_any_text_of_a_block(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    texts = ["some other text", notice[2:], "one more", notice[6:] + " of it", "ends with " + notice[:-5], notice]
    got = by_id(scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)))
    assert [got[i].labels for i in range(6)] == ["", "mit", "", "mit", "mit", "mit"]
    assert [m.edits for i in (1, 3, 4, 5) for m in got[i].matches] == [2, 6, 4, 0]


def test_quality_counts_and_binomial_tail(spark, real):
    for i, r in by_id(Q.op5_quality(spark, FOLDER)).items():
        text = real.text[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    tails = spark.sql(f"SELECT n, k, exp({log_tail('n', 'k', '0.05')}) AS p FROM VALUES (100L, 2L), (100L, 0L), (60L, 1L), (2L, 0L), (900L, 44L) AS t(n, k)").collect()
    for r in tails:
        exact = sum(np.prod([(r.n - i) / (i + 1) for i in range(j)]) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(exact)


def test_cutoffs_spare_good_texts(spark):
    rng = random.Random(3)
    text = lambda s: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}{'#' if rng.random() < s else ''}" for _ in range(60))
    rows = [(i, text(0.02 if i % 5 else 0.9), "en") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(2500)], "doc_id int, quality int")
    got = by_id(quality_rules(docs, labels))
    good = [got[i].kept for i in range(2500) if i % 5]
    assert 1 - sum(good) / len(good) <= 0.05 and not any(got[i].kept for i in range(0, 2500, 5))


def test_edits_never_turn_one_licence_into_another(spark):
    texts = ["licensed under cc by nd", "licensed under cc by 4 0", "licensed under the gnu general public license version 1",
             "released under the bsd license", "released under the isc license", "relesed undr the mit license", "licensed under cc by sa",
             "licensd under the gnu general public licence version 3", "permission is herby granted free of charge to any persn obtaining a copy"]
    got = by_id(scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))
    assert [got[i].labels for i in range(9)] == ["", "", "", "", "", "mit", "cc-by-sa", "gpl-3", "mit"]


def edit_distance_inside(notice, text):
    """Least edits of the notice against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bounded_errors_against_all_alignments(spark):
    rng = random.Random(8)
    notices = {n: label for n, label in NOTICES.items() if not telling(n)}
    texts = []
    for notice in notices:
        for edits in range(0, len(notice) // 10 + 3):
            t = list(notice)
            for _ in range(edits):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [t[i], rng.choice("jkq")], [rng.choice("xyz")]])
            texts.append("one two " + "".join(t) + " three four")
    texts = [t for t in texts if not telling(t)]  # an edit may make such a word by chance
    got = by_id(scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), base={}, notices=notices))
    for i, t in enumerate(texts):
        expected = {label for n, label in notices.items() if edit_distance_inside(n, f" {t} ") <= len(n) // 10}
        assert set(filter(None, got[i].labels.split(","))) == expected, t


def test_kept_follows_a_plain_sequence_of_exact_tests(spark):
    rng = random.Random(11)
    text = lambda s: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}{'#' * rng.randint(1, 9) if rng.random() < s else ''}" for _ in range(60))
    strata = ["en", "de", None, ""]
    rows = [(i, text(rng.choice([0, 0.05, 0.5]) if i % 3 else 0.02), strata[(i // 3) % 4]) for i in range(9000)]
    labels = [(i, int(i % 3 == 0 or i % 10 == 1)) for i in range(9000)]
    got = by_id(quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string"), spark.createDataFrame(labels, "doc_id int, quality int")))

    def rates(r):
        return (r.n_symbols / max(r.word_chars, 1), r.n_repeat_words / max(r.n_words, 1), 0.0, r.word_chars / max(r.n_words, 1))

    tops, good, steps = (1.0, 1.0, 1.0, 40.0), dict(labels), {}
    for stratum in strata:
        own = [rates(got[i]) for i, _, s in rows if s == stratum and good[i] and not got[i].base_failed]
        for rule in range(4):
            limit = None
            for step in range(39, -1, -1):
                k = sum(min(40, math.ceil(v[rule] * 40 / tops[rule])) > step for v in own)
                tail = sum(math.comb(len(own), j) * 0.0125**j * 0.9875 ** (len(own) - j) for j in range(k + 1))
                if k >= len(own) * 0.0125 or tail > 0.05 / 16:
                    break
                limit = step * tops[rule] / 40
            steps[stratum, rule] = limit
    assert any(v is not None and v < 1 for v in steps.values())
    for i, _, stratum in rows:
        over = any(steps[stratum, q] is not None and v > steps[stratum, q] for q, v in enumerate(rates(got[i])))
        assert got[i].kept == (not got[i].base_failed and not over), i


def test_disguised_words_are_restored_and_scored(spark, real):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    decoder = Decoder(log_probabilities([tuple(r) for r in trigram_counts(docs.select("text")).collect()]))
    assert decoder.restored("you 1d10t, i d i o t and idiooot") == ["idiot", "idiot", "idiot"]
    assert decoder.restored("") == [] and decoder.restored("plain words. 12 + 3") == []
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["tion", "ther", "onen", "edin", "hati", "erst"]) + rng.choice(["a", "o", "e"]) for _ in range(30))
    rows = [(i, plain() + (" blockhead " if i % 4 == 0 else " ") + plain()) for i in range(400)]
    rows += [(1000, "bl0ckh3ad"), (1001, plain()), (1002, None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id int, toxic int")
    got = by_id(score_toxicity(spark.createDataFrame(rows, "doc_id int, text string"), labels))
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].predicted == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, int(i % 4 == 0)) for i in range(400) if got[i].held_out]
    assert all(p == y for p, y in held)


def test_long_clean_texts_of_new_words_are_not_toxic(spark):
    rng = random.Random(12)
    marks = [f"bad{i}word" for i in range(40)]
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**12)}" for _ in range(n)]
    docs = [(i, " ".join(fresh(10) + (rng.sample(marks, 20) if i % 2 else []))) for i in range(400)]
    docs += [(i, " ".join(fresh(60_000))) for i in range(400, 412)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = by_id(score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels))
    assert len({got[i].score for i in range(400, 412)}) == 1 and not any(got[i].predicted for i in range(400, 412))
    assert all(got[i].predicted == i % 2 for i in range(400))


def test_archives_round_trip(spark):
    rows = [(1, "http://a.b/x", "a" * 120), (2, "http://a.b/y", "a" * 120), (2, "http://a.b/y", "a" * 120), (3, None, None), (4, "http://c", "z\r\n\r\nWARC/1.1\r\nq")]
    rows += [(5, "u\r\nX: y", "\r\n\r\n" * 3 + "é" * 100), (6, "http://a.b/z", "b" * 99), (7, "http://a.b/z", "b" * 99)]
    rows += [(100 + i, f"http://h.org/{i % 7}", f"page {i} " * 20) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archive(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == hashlib.sha256(body.encode()).hexdigest()
        assert r.refers_to == (1 if r.page_id == 2 else None) and r.record_type == ("revisit" if r.page_id == 2 else "response")
    keys = [(r.url_key, r.time, str(r.page_id)) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert keys == sorted(keys) and archive(pages.limit(0)).count() == 0


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        assert [runs[r][i] for r, i in LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_encoder_equals_the_tokenizer():
    encoder = Encoder(Q.tokenizer_path(), keep=300)
    rng = random.Random(1)
    signs = " \n\t\r  '''sdtmrvel abcéüß12٣²!?.,-—“”…　\u0085漢字😀\x1c\x00A"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["<|endoftext|> a", "don't I'll", "", " "]
    for k in range(0, len(texts), 50):
        ids, at = encoder.encode(texts[k : k + 50])
        for i, t in enumerate(texts[k : k + 50]):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_subset_sums_and_window_plans():
    rng = random.Random(2)
    for _ in range(100):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * m for s in sums for m in range(n + 1)}
        chosen = closest(counts, room)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room)
        assert all(m <= counts[k] for k, m in chosen.items())
        used = collections.Counter()
        for times, window in plan_windows(counts, 40):
            assert sum(k * m for k, m in window.items()) <= 40
            for k, m in window.items():
                used[k] += times * m
        assert used == counts


def test_packed_pieces_hold_every_token_once(spark, real):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    got = Q.op8_packing(spark, FOLDER).toPandas()
    for i, text in real.text.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    got = got.sort_values(["sequence_id", "offset"])
    fill = got.groupby("sequence_id").length
    assert (fill.cumsum() - got.length == got.offset).all() and fill.sum().max() <= 2048
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(f"{rng.choice('abcdefghij')}{rng.randint(0, 400)}" for _ in range(150)) for _ in range(25)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(rng.randint(0, 8)):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), "", None, "a b", "A  b!", "c", "!!"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in enumerate(rows) if (w := words(t))}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(rows))}


def linked_in_bands(spark, texts, **bands):
    """Class of each row, from all pairs of rows that share a band."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    members = collections.defaultdict(list)
    for r in sketches(docs, 5, **bands).collect():
        for band in r.bands:
            members[band].append(r.id)
    grams = [np.array([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)], np.uint64) for w in map(words, texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in {(i, j) for m in members.values() for i in m for j in m if i < j}:
        if max(similarity(grams[i], grams[j])[:2]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}, max(map(len, members.values()))


def test_every_link_of_a_large_band_is_found(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    common = fresh(300)
    rows = []
    for _ in range(60):  # pairs of twins that share a passage with all others
        own = fresh(100)
        rows += [" ".join(common + own), " ".join(common + own[:-10] + fresh(10))]
    copy = fresh(100)
    rows += [" ".join(common + copy[:i] + fresh(1) + copy[i + 1 :]) for i in range(90)]
    bands = {"keep": 1, "rows": 1, "number": 1}
    expected, largest = linked_in_bands(spark, rows, **bands)
    assert largest > 150 and len(set(expected.values())) > 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs, **bands).collect()} == expected


def excerpts(seed):
    """Edited copies of a long text, and pairs of excerpts of it that share only k-mers of the long text."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    middle, parts = fresh(40), [fresh(20) for _ in range(40)]
    whole = middle + [w for part in parts for w in part]
    rows = [whole[:i] + fresh(1) + whole[i + 1 :] for i in range(60, 800, 20)]
    for part in parts:
        rows += [middle + part, middle + part[3:]]
    return [" ".join(r) for r in rows]


def test_excerpts_of_the_hub_are_linked(spark):
    rows = excerpts(58)
    bands = {"keep": 1, "rows": 1, "number": 1}
    expected, largest = linked_in_bands(spark, rows, **bands)
    assert largest > 100 and len(set(expected.values())) > 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs, **bands).collect()} == expected


def test_moved_and_repeated_sections_are_linked(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        own, other = fresh(200), fresh(200)
        rows += [own, own[100:] + own[:100], other, other + other]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id int, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {i: i // 2 * 2 for i in range(len(rows))}


def test_alignment_never_exceeds_the_bound_that_prunes_it():
    rng = np.random.default_rng(4)
    for _ in range(300):
        # repeated passages: the set similarity to a hub does not bound the alignment, the labelled one does
        a = np.concatenate([np.arange(20), np.tile(np.arange(100, 105), 20)])[rng.permutation(120) if rng.random() < 0.3 else slice(None)].astype(np.uint64)
        b = a.copy()
        b[rng.integers(0, 120, rng.integers(0, 20))] = rng.integers(1000, 2000)
        aligned, _, bound = similarity(a, b)
        assert aligned <= bound + 1e-12


def expected_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(2)
    parts = ["@", ".", "a", "b-", "_", "1", "22", "255", "256", "+", "+1 (98", "-", " ", "4111111111111111", " 4111 1111 1111 1111", "x@y.z", "\n", "é", "😀"]
    parts += ["5", ".7", "(3)", "", "", "", "tel: "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8.9", "1" * 3000, "a" * 100_000, "a@a" + ".a" * 20_000, "1 " * 20_000 + "1", "1." * 20_000 + "1", " x@y.zz" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    got = by_id(find_personal_data(docs))
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == expected_spans(t)
        assert {tuple(s) for s in got[i].base} <= {(s.kind, s.start, s.stop) for s in got[i].spans}
        assert list(dict.fromkeys(s.kind for s in got[i].base)) == [k for k in BASE if any(s.kind == k for s in got[i].base)]


def test_reliabilities_equal_a_plain_recursion():
    rng = random.Random(6)
    patterns = [(k, *(rng.choice([-1, 0, 1]) for _ in range(4)), rng.randint(1, 40)) for k in ("card", "iban", "secret") for _ in range(8)]
    prior, shares = {k: 0.5 for k in ("card", "iban", "secret")}, [{t: dict(SEED[t]) for t in (0, 1)} for _ in range(4)]
    for _ in range(50):
        post = []
        for k, *votes, _ in patterns:
            yes, no = prior[k], 1 - prior[k]
            for j, v in enumerate(votes):
                yes, no = yes * shares[j][1][v], no * shares[j][0][v]
            post.append(1.0 if k == "card" and votes[0] == 1 else yes / (yes + no))
        for k in prior:
            own = [(q, p[-1]) for p, q in zip(patterns, post) if p[0] == k]
            prior[k] = 0.25 + 0.5 * sum(q * n for q, n in own) / sum(n for _, n in own)
        for j in range(4):
            for t in (0, 1):
                weight = [(q if t else 1 - q) * p[-1] for p, q in zip(patterns, post)]
                for v in (-1, 0, 1):
                    shares[j][t][v] = 0.5 * SEED[t][v] + 0.5 * sum(w for p, w in zip(patterns, weight) if p[1 + j] == v) / sum(weight)
    assert reliabilities(patterns) == pytest.approx(post)
    # ten times the spans give the same answer
    assert reliabilities([(*p[:-1], 10 * p[-1]) for p in patterns]) == pytest.approx(post)


def test_added_spans_do_not_depend_on_the_size_of_the_corpus(spark):
    planted = ["token = 3f786850e387550fdab836ed7e6dc881", "my ssn: 123-45-6789", "version 000-12-0000", "password: ghp_ABCDEFGHIJKLMNOPQRSTUVWX"]
    found = []
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
        own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string")
        rows = find_personal_data(texts.union(own)).where("doc_id < 0").collect()
        found.append({r.doc_id: {(s.kind, s.start, s.stop) for s in r.spans} for r in rows})
    assert found[0] == found[1]
    assert found[0][-1] == {("secret", 8, 40)} and found[0][-2] == {("national_id", 8, 19)}
    assert found[0][-3] == set() and found[0][-4] == {("secret", 10, 38)}


def test_redaction_covers_overlapping_spans(spark):
    spans = "array(named_struct('kind', 'b', 'start', 4, 'stop', 9), named_struct('kind', 'a', 'start', 2, 'stop', 6), named_struct('kind', 'c', 'start', 11, 'stop', 12))"
    assert spark.sql(f"SELECT {redacted('t', spans)} AS r FROM VALUES ('abcdefghijklmn') AS v(t)").head()[0] == "ab<a><b>jk<c>mn"


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(90))
    clean = [text() for _ in range(60)]
    passage = " ".join(f"q{i}" for i in range(40))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " tail"), (102, passage + " " + text()), (103, "write to someone@mail.example.com now " + text())]
    rows += [(200 + i, text() + " blockhead " + text()) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i >= 200)) for i, _ in rows if i < 60 or i >= 200]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
        current.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in current.collect()}
    assert set(kept) == set(range(60)) | {103} and kept[103].startswith("write to <email> now ")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)


def test_pipeline_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    rng = random.Random(10)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(90))
    a, b, c, passage = text(), text(), text(), " ".join(f"q{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, c), (2, passage), (2, text()), (3, None), (3, ""), (4, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(
        [(1, a), (1, b), (None, c), (2, passage), (2, rows[7][1]), (3, None), (3, ""), (4, "one")]
    )
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(r for r in rows if r[1] != passage)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.personal_data):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_send_texts_to_python_in_small_batches(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes])})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.personal_data, corpus_pipeline.packing):
            spark.conf.set(name, "64m")
            stage(spark, rows.limit(0), str(tmp_path))
            assert max(r.size for r in rows.mapInArrow(sizes, "size bigint").collect()) < 5 << 20
        spark.conf.set(name, "1m")  # a lower limit stays
        corpus_pipeline.personal_data(spark, rows.limit(0), str(tmp_path))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
