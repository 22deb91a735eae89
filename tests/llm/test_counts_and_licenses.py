"""Token counts against the tokenizers library, license scans against brute-force containment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import license_scan, token_count

HARD = ["", None, "a", " ", "  ", "a  b", "\n", "a\n b\n\n c", " a ", "日本語 テスト", "😀😀 x", "<0x41> <s> <unk>", "▁▁ ▁x", "é ́x", "\t\t a", "ﬀ" * 50, "word " * 4000]


def noise(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\t\xa0abé日ñ1.,'sß́▁😀") for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(token_count.read_vocabulary(token_count.default_path()), unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(token_count.SPACE), normalizers.Replace(" ", token_count.SPACE)])
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts])]


def test_counts_equal_the_library(library):
    texts = HARD + noise(4000)
    assert token_count._counter(token_count.default_path()).count_many(texts) == library(texts)


def test_ties_and_unknowns_of_a_small_vocabulary():
    from tokenizers import Tokenizer, models

    words = [(token_count.UNKNOWN, 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁", -1.0), ("cd", -0.5)]
    counter = token_count.Counter(words)
    library = Tokenizer(models.Unigram(words, unk_id=0, byte_fallback=False))
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choice("abcd▁") for _ in range(rng.randrange(1, 12)))
        fused = len(library.encode(text).ids)
        unknown = len(re.findall(r"c(?!d)|(?<!c)d", text)) - len(re.findall(r"(?:c(?!d)|(?<!c)d)+", text))
        assert counter.viterbi(text) == fused + unknown


def test_count_query(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    expected = dict(zip((r["doc_id"] for r in rows), library([r["text"] for r in rows]), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.op6_token_count(spark, small).collect()} == expected
    odd = spark.createDataFrame([(None, "a b", 1), (2, None, 1), (2, "", 1)], "doc_id long, text string, n_tokens int")
    assert sorted(r["n_tokens"] for r in token_count.count_tokens(odd).collect()) == [0, 0, 2]
    assert token_count.count_tokens(odd.limit(0)).count() == 0


def pairs(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {(words[i], words[i + 1]) for i in range(len(words) - 1)}


TEMPLATES = {name: pairs(text) for name, text in license_scan.TEMPLATES}


def test_pieces_lie_in_windows():
    for n in range(2, 64):
        cover = {w for s, e in license_scan.pieces_of(n) for w in range(s, e)}
        assert cover == set(range(n)) and all(e - s <= license_scan.PIECE for s, e in license_scan.pieces_of(n))
    for start in range(30):  # a piece anywhere is inside the window that begins at or before it
        window = start // license_scan.STRIDE * license_scan.STRIDE
        assert window + license_scan.WINDOW >= start + license_scan.PIECE


def test_licenses_of_the_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in license_scan.op4_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert set(found) == set(texts)
    for d, t in texts.items():
        whole = {n for n, s in TEMPLATES.items() if s <= pairs(t)}
        got = {x.split(":")[0] for x in found[d]["licenses"].split(",") if x}
        assert whole <= got and found[d]["n_licenses"] == len(got)
        assert all(len(TEMPLATES[n] & pairs(t)) >= 0.7 * len(TEMPLATES[n]) for n in got)


def test_every_template_anywhere_and_edited(spark):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(500)]
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        for shift in range(7):
            before = " ".join(rng.choice(filler) for _ in range(shift + 20 * (shift % 2)))
            rows.append((len(rows), f"{before} {text.upper() if shift % 3 == 0 else text}; {' '.join(rng.choice(filler) for _ in range(shift * 3))}", name))
    plain = [(1000 + i, " ".join(rng.choice(filler + ["license", "under", "the", "version"]) for _ in range(60)), None) for i in range(40)]
    df = spark.createDataFrame(rows + plain, "doc_id long, text string, license string")
    got = {r["doc_id"]: {x.split(":")[0] for x in r["licenses"].split(",") if x} for r in license_scan.licenses(df).collect()}
    assert all(name in got[i] for i, _, name in rows)
    assert not any(got[i] for i, _, _ in plain)


def test_license_edges_and_native_plan(spark, small):
    t = "This file is released under the MIT License."
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (None, t, "x"), (2, None, "x"), (3, "", None), (4, "MIT", "x")], "doc_id long, text string, license string")
    rows = sorted(((r["doc_id"] or 0), r["licenses"]) for r in license_scan.licenses(df).collect())
    assert rows == [(0, "MIT:1.0"), (1, "MIT:1.0"), (1, "MIT:1.0"), (2, ""), (3, ""), (4, "")]
    assert license_scan.licenses(df.limit(0)).count() == 0
    plan = license_scan.op4_license_scan(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    with pytest.raises(ValueError):
        license_scan.template_table(spark, (("long", " ".join(f"w{i}" for i in range(70))),), 4)
    assert license_scan.scan(df, templates=(("two", "mit license"),)).where(F.col("license") == "two").count() == 2


def test_full_texts_headers_and_tags(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    fsf = "it under the terms of the GNU {} as published by the Free Software Foundation, either version {}"
    rows = [(name, text) for name, text in license_scan.texts()]
    for name, text in license_scan.texts():  # every thirtieth word is another one
        rows.append((name, " ".join(rng.choice(words) if i % 30 == 7 else w for i, w in enumerate(text.split()))))
    rows += [("GPL-3.0", fsf.format("General Public License", "3")), ("AGPL-3.0", fsf.format("Affero General Public License", "3")), ("LGPL-2.1", fsf.format("Lesser General Public License", "2.1"))]
    rows += [(name, f"# {text}") for name, text in license_scan.TAGS]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    df = spark.createDataFrame([(i, f"{fill(9)} {text} {fill(9)}") for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: {x.split(":")[0] for x in r["licenses"].split(",") if x} for r in license_scan.licenses(df).collect()}
    assert [(name, got[i]) for i, (name, _) in enumerate(rows) if name not in got[i]] == []
    texts = len(license_scan.texts())
    assert [(name, got[i]) for i, (name, _) in enumerate(rows) if i >= 2 * texts and got[i] != {name}] == []


def test_separate_licenses_of_one_text(spark):
    rng = random.Random(7)
    between = " ".join(f"word{rng.randrange(500)}" for _ in range(300))
    apache, gpl = dict(license_scan.TEMPLATES)["Apache-2.0"], "licensed under the GNU General Public License version 3"
    rows = [(0, f"{apache} {between} {gpl}"), (1, f"{gpl} {between} {apache}"), (2, f"{apache}; {gpl}"), (3, f"{between} {gpl} {between}")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]): r["first_word"] for r in found}
    assert set(got) == {(0, "Apache-2.0"), (0, "GPL-3.0"), (1, "Apache-2.0"), (1, "GPL-3.0"), (2, "Apache-2.0"), (2, "GPL-3.0"), (3, "GPL-3.0")}
    assert got[0, "GPL-3.0"] == 308 and got[1, "Apache-2.0"] == 309


def brute_licenses(text, templates, containment=0.7):
    """(license, share) of every template by places of its word pairs, runs and overlaps, without retrieval."""
    words_of = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    words = words_of(text)
    found = list(zip(words, words[1:]))
    runs = []
    for name, t in templates:
        order = list(zip(words_of(t), words_of(t)[1:]))
        own, size = set(order), len(set(order))
        nth = {p: order.index(p) for p in own if order.count(p) == 1}
        apart = max(license_scan.WINDOW, size // 4) if size > 63 else license_scan.WINDOW
        run, last, before = [], None, None
        for at, p in enumerate(found):
            if p not in own:
                continue
            again = size <= 63 and p in nth and before is not None and 2 * (before - nth[p]) > size
            if last is not None and (at - last > apart or again):
                runs.append((name, size, run))
                run = []
            run, last, before = [*run, at], at, nth.get(p, before)
        runs.append((name, size, run))
    good = [(n, len({found[i] for i in run}), size, set(run)) for n, size, run in runs]
    good = [(n, k / size, k * k / size, places) for n, k, size, places in good if k / size >= containment]
    best = {}
    for n, share, rank, places in good:
        if not any(m != n and r > rank and 2 * len(places & p) > len(places) for m, _, r, p in good):
            best[n] = max(best.get(n, 0), share)
    return {(n, round(s, 4)) for n, s in best.items()}


def test_scan_equals_a_scan_without_bands(spark):
    """Documents, edited and adjacent notices, scattered words and a template of 200 lines, against brute force."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    long = ("Long-1.0", "\n".join(" ".join(rng.choice(words[:300]) + rng.choice("abc") for _ in range(9)) for _ in range(200)))
    templates = (*license_scan.TEMPLATES, *license_scan.HEADERS, long)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for name, t in templates:
        parts = t.split()
        for drop in (0, 1, 2):
            kept = [w for i, w in enumerate(parts) if i not in set(rng.sample(range(len(parts)), min(drop, len(parts) - 2)))]
            texts.append(" ".join(fill(rng.randrange(30)) + kept + fill(rng.randrange(12)) + rng.choice(templates[:-1])[1].split() + fill(5)))
    scattered = "People are licensed under {0} the law of {0} The apache license plate {0} each license, version 2 plan {0} a version 2.0 of it"
    texts += [scattered.format(" ".join(fill(n))) for n in (240, 40, 15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in license_scan.scan(df, templates=templates).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], round(r["containment"], 4)))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute_licenses(t, templates), t[:200]
    assert not any(got.get(len(texts) - k) for k in (1, 2, 3))
