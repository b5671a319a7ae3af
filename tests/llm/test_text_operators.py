import random

import pytest
from pyspark.sql import functions as F

from foliomill.llm import leakage, lookalike, names, ocr_repair, truncation


def test_leaks(spark):
    rnd = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        if d % 3 == 0:
            part = rnd.choice(items)[1].split()
            at = rnd.randint(0, max(0, len(part) - 13))
            w[len(w) // 2 : len(w) // 2] = part[at : at + rnd.choice([8, 12, 13, 20])]
        docs.append((d, rnd.choice([" ", ", ", "\n", " -- "]).join(w).upper()))
    docs += [(500, None), (501, ""), (502, " ".join(["v1"] * 20_000) + " " + items[3][1]), docs[0]]
    items += [(90, None), (91, "one"), items[0]]
    dd = spark.createDataFrame(docs, "doc_id int, text string").withColumn("gram", F.lit("clash")).withColumn("w", F.lit(0))
    ii = spark.createDataFrame(items, "item_id int, text string").withColumn("pos", F.lit("clash"))
    got = leakage.leaks(dd, ii).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t in docs for i, s in items if t and s and runs(t.lower().replace(",", " ").replace("--", " ").split(), 13) & runs(s.split(), 13)}
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= 13} == want and want
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0


def test_alignment():
    def slow(a, b):
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 25))] for _ in range(2))
        assert leakage.align(a, b)[0] == slow(a, b)
    assert leakage.align("a b c d".split(), "x b c y".split())[2] == 2


C = chr
SAME = [("fi", C(0xFB01)), (C(0xE9), "e" + C(0x301)), ("a b", "a" + C(0xA0) + "b"), ("a b", "a" + C(0x3000) + "b"), ("ab", "a" + C(0x200B) + "b"), ("a-b", "a" + C(0x2010) + "b"), ("a-b", "a" + C(0x2011) + "b"), ("paper", C(0x440) + C(0x430) + C(0x440) + "er"), ("ABC", C(0xFF21) + C(0xFF22) + C(0xFF23)), ("co", C(0x441) + C(0x3BF)), ("ab", "a" + C(0xAD) + "b")]
DIFFERENT = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a.", "a,"), ("l", "1"), ("O", "0"), ("a-b", "a_b")]


def test_look_alikes(spark):
    texts = [t for p in SAME + DIFFERENT for t in p]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, C(0x200B)), (0, texts[0]), (103, "x" * 50_000 + C(0xE9)), (104, "x" * 50_000 + "e" + C(0x301))]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("form", F.lit("clash"))
    to = lookalike.representatives(lookalike.character_counts(df.select("text")))
    form = lookalike.Rewriter(to)
    for a, b in SAME:
        assert form(a) == form(b)
    for a, b in DIFFERENT:
        assert form(a) != form(b)
    got = {tuple(r) for r in lookalike.look_alike_pairs(lookalike.one_form(df, "id", "text", to), "id").collect()}
    want = {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if a is not None and b is not None and i < j and a != b and form(a) == form(b)}
    assert got == want and {(103, 104), (101, 102)} <= got
    assert lookalike.look_alike_pairs(lookalike.one_form(df.limit(0), "id", "text", to), "id").count() == 0
    assert lookalike.character_counts(df.limit(0).select("text")) == {}


def test_representative_is_the_most_frequent():
    assert lookalike.representatives({"-": 1, "‐": 9})["-"] == "‐"
    assert lookalike.representatives({"а": 9, "a": 1})["a"] == "а"
    assert lookalike.representatives({"ﬁ": 99, "f": 1, "i": 1})["ﬁ"] == "fi"
    assert lookalike.representatives({"é": 1})["e" + C(0x301)] == "é"


PEOPLE = [
    ["Robert J. Vihutafi", "Vihutafi, Rboert (ed.)", "R J. Vihutafi et al.", "Bob Vihutafi, MD", "Prof Vihutafi, Robert", "VIHUTAFI, R."], ["Magdalena Vihutafi", "Vihutafi, Lena"],
    ["Institute of Paed. Physiology, Jutejimas", "Jutejimas: Paediatric Physiol. Institute", "The Jutejimas Inst. for Paediatric Physiology"], ["Institute of Renal Physiology, Jutejimas"],
    ["Ignacio Hagumezas", "Nacho Hagumezas et al.", "Hagumezas Ignacio"], ["Dorothea Hagumezzi"],
]
WORKS = [
    ["A Clinical Handbook to Dejuwitros Syndrome of the Heart (vol 2)", "DEJUWITROS SYNDROME OF THE HEART: A CLINICAL HDBK., VOLUME II", "Handbook (clinical) - Dejuwitros Synd., Heart - 2"], ["Dejuwitros Syndrome of the Heart, Vol. 1"],
    ["Ramuuvusis Syndrome of the Lung", "Clinical Atlas: the Lung in Ramuuvusis Syndroem", "Ramuuvusis_Syndrome_of_the_Lung_(2nd ed.)", "Ramuvusis Syndrome of the Lung, third edition"], ["Ramuuvusis Disease of the Lung"],
]


@pytest.mark.parametrize("field,groups", [("author", PEOPLE), ("title", WORKS)])
def test_names(spark, field, groups):
    rows = [(n, x) for n, x in enumerate(x for g in groups for x in g)] + [(100, None), (101, " "), (102, "Unknown" if field == "author" else ""), (0, groups[0][0])]
    df = spark.createDataFrame(rows, f"book_id int, {field} string").withColumn("v", F.lit("clash")).withColumn("entity", F.lit(1))
    got = {tuple(r) for r in names.linked_pairs(names.link_names(df, "book_id", field, field), "book_id").collect()}
    ids, want = iter(range(99)), set()
    for g in groups:
        own = [next(ids) for _ in g]
        want |= {(a, b) for a in own for b in own if a < b}
    assert got == want
    assert names.link_names(df.limit(0), "book_id", field, field).count() == 0


def test_variants_of_a_work_with_many_spellings_are_linked(spark):
    plain, typed = "Gejesaner Disease of the Thyroid", ["Disaese", "Diseas", "Dissease", "Diesase", "Dicease", "Dizeae"]
    rows = [plain] + [f"{plain.replace(a, b)}" for a, b in [("Thyroid", "Thyriod"), ("Thyroid", "Thyrod"), ("Disease", "Diease")]] + [plain.replace("Disease", x) for x in typed[:5]] + ["Gejesaner Disaese of the Thyriod"]
    # other spellings of the work, so that each of its words is frequent
    rows += [f"{plain.replace(' of ', sep)}{end}" for sep in (" of ", " - ", ": ", " (of) ", " / ") for end in ("", ".", "!", ";", "?", " .", " -", " *")][1:]
    rows += ["Gejesaner Disease of the Lung", "Mobutiver Disease of the Thyroid"]
    df = spark.createDataFrame(list(enumerate(rows)), "book_id int, title string")
    got = {r.book_id: r.entity for r in names.link_names(df, "book_id", "title", "title").collect()}
    assert len(got) == len(rows) and {got[i] for i in range(len(rows) - 2)} == {got[0]}
    assert len(set(got.values())) == 3


def test_an_initial_that_may_be_two_people_is_left_out(spark):
    df = spark.createDataFrame([(1, "Robert Zokostile"), (2, "Rosalind Zokostile"), (3, "R. Zokostile")], "book_id int, author string")
    assert names.linked_pairs(names.link_names(df, "book_id", "author", "author"), "book_id").count() == 0


def test_similarities():
    assert abs(names.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3 and abs(names.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-3
    assert names.edits("abcd", "abdc") == 1 and names.edits("abcd", "xyz") == 3
    assert names.jaro_winkler("", "a") == 0.0


def test_scanned(spark):
    body = "the patients were observed for recurrence of the condition in the long-term group and needed no treatment"
    rows = [(i, f"c{i % 40}", i, body, "text_layer", None) for i in range(400)]
    noisy = [
        (1000, "the pati-\nents were obser¬\nved", {"hyphen"}), (1001, "in the long-\nterm group", set()), (1002, "the pafients werc observed", {"glyph"}), (1003, "Page 7\nthe group", {"pageno"}),
        (1004, "[ 3 ]", {"pageno"}), (1005, "The Journal of Things | 4\nneeded no", {"header"}), (1006, "ABC12 group", set()), (1007, "", set()), (1008, "rec0rded needcd", {"glyph"}),
    ]
    rows += [(i, "s", i - 990, t, "ocr", None) for i, t, _ in noisy] + [(1100 + p, "s", p + 50, f"The Journal of Things | {p}", "ocr", None) for p in range(5)] + [(1200, "s", 1, None, "ocr", None), (1201, "s", 1, "Page 3", "text_layer", 7), (1202, "s", 1, "Page 3", "text_layer", 8), (1203, None, None, "p. 9", "ocr", 99), (1003, "s", 13, "Page 7\nthe group", "ocr", None)]
    blocks = spark.createDataFrame(rows, "block_id bigint, document_id string, page_number int, text string, source string, raw_id bigint").withColumn("headers", F.lit("clash"))
    raw = spark.createDataFrame([(7, True), (7, True), (8, False), (9, None)], "raw_id bigint, from_ocr boolean")
    out = ocr_repair.repair_scanned(blocks, raw)
    got = {r.block_id: (r.text, set(r.kinds)) for r in out.collect()}
    assert out.count() == len(got)
    for i, _, kinds in noisy:
        assert got[i][1] == kinds, i
    assert got[1000][0] == "the patients were observed" and got[1001][0] == "in the long-term group" and got[1002][0] == "the patients were observed" and got[1004][0] == ""
    assert got[1200] == (None, set()) and got[1201][1] == {"pageno"} and 1202 not in got and got[1203][1] == {"pageno"}
    assert ocr_repair.repair_scanned(blocks.limit(0), raw.limit(0)).count() == 0


def test_every_candidate_is_found():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6))): rnd.randint(3, 9) for _ in range(200)}
    lookup = ocr_repair.Lookup(words)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for _ in range(60):
        w = "".join(rnd.choice("abc") for _ in range(5))
        near = {x for x in words if x != w and edits(w, x) <= 1}
        assert near <= set(lookup.candidates(w, ocr_repair.EDIT_COST))


def test_the_word_before_decides_between_equal_candidates(spark):
    rows = [("the carol sang", )] * 30 + [("a carat weighed",)] * 40 + [("the carol",)] * 5
    words, _, pairs, _ = ocr_repair.vocabulary(spark.createDataFrame(rows, "t string"))
    lookup = ocr_repair.Lookup({"list": 50, "fist": 60}, None)
    assert lookup.meant("f1st") == "fist" and lookup.meant("1ist") == "list"
    assert pairs[ocr_repair.pair_bucket("the", "carol")] >= 35 > pairs[ocr_repair.pair_bucket("a", "carol")]
    two = ocr_repair.Lookup({"bearing": 9, "hearing": 12}, np_pairs({("of", "bearing"): 7}))
    assert two.meant("xearing", "of") == "bearing" and two.meant("xearing", "") == "hearing"


def test_misreads_outside_the_list_are_repaired(spark):
    words = ["patients", "observed", "treatment", "study", "clinical", "cardiac", "blood", "fever", "hospital", "diagnosis", "recurrence", "syndrome", "therapy", "vascular"]
    blocks = [(i, "c", i, " ".join(words), "text_layer", None) for i in range(20)]
    misread = {"patiemts": "patients", "obserued": "observed", "treetment": "treatment", "ohserved": "observed", "clinicol": "clinical", "studv": "study", "eardiac": "cardiac", "hlood": "blood", "tever": "fever", "hospitel": "hospital", "diaqnosis": "diagnosis"}
    blocks += [(100 + i, "s", i, f"the {w} was", "ocr", None) for i, w in enumerate(misread)]
    df = spark.createDataFrame(blocks, "block_id bigint, document_id string, page_number int, text string, source string, raw_id bigint")
    got = {r.block_id: (r.text, r.kinds) for r in ocr_repair.repair_scanned(df, spark.createDataFrame([], "raw_id bigint, from_ocr boolean")).collect()}
    assert [got[100 + i] for i in range(len(misread))] == [(f"the {w} was", ["glyph"]) for w in misread.values()]
    # known words that are too rare for the trie stay as they are
    more = df.unionByName(df.where("block_id < 20").withColumn("text", F.lit("fewer words"))).unionByName(df.where("block_id < 40 AND source = 'text_layer'").withColumn("text", F.lit("fever"))).unionByName(df.where("block_id < 5").withColumn("text", F.lit("tever")))
    kept = {r.block_id: r.text for r in ocr_repair.repair_scanned(more, spark.createDataFrame([], "raw_id bigint, from_ocr boolean"), most=16).collect()}
    assert kept[100 + list(misread).index("tever")] == "the tever was" and kept[100] == "the patients was"
    # held out: a letter of each word replaced at random by one that the list doesn't have for it
    rnd, listed, hit, n = random.Random(12), set(ocr_repair.MISREAD), 0, 0
    lookup = ocr_repair.Lookup({w: 20 for w in words})
    for w in words:
        for _ in range(20):
            at = rnd.randrange(len(w))
            c = rnd.choice("abcdefghijklmnopqrstuvwxyz")
            if c != w[at] and (c, w[at]) not in listed:
                n += 1
                hit += lookup.meant(w[:at] + c + w[at + 1 :]) == w
    assert hit >= 0.98 * n and n > 200
    # a word that pages without scanning have is left alone
    assert ocr_repair.Lookup({"casual": 500, "causal": 1}).meant("causal") is None


def test_words_beyond_one_trie_are_looked_up_too(spark):
    none = spark.createDataFrame([], "raw_id bigint, from_ocr boolean")
    often = "patients hospital syndrome vascular bearing therapy"
    rare = {"cholestasis": 5, "myelofibrosis": 4, "hearing": 6, "eosinophilia": 3, "lymph-node": 4, "cross-over": 3, "crossover": 4, "patlents": 3, "thorapy": 3}
    clean = [often] * 400 + [w for w, n in rare.items() for _ in range(n)]
    misread = {
        "cholestesis": "cholestasis", "rnyelofibrosis": "myelofibrosis", "cosinophi1ia": "eosinophilia", "Cholestasls": "Cholestasis", "patiemts": "patients", "thorapy": "thorapy", "patlents": "patients",
        "bearlng": "bearing", "xearing": "bearing", "hearlng": "hearing", "lymph-\nnode": "lymph-node", "1ymph-\nnode": "lymph-node", "cross-\nover": "crossover", "cholesta-\nsls": "cholestasis", "xxxxxxx": "xxxxxxx",
    }
    rows = [(i, "c", i, t, "text_layer", None) for i, t in enumerate(clean)] + [(10_000 + i, "s", i, f"the {w} was", "ocr", None) for i, w in enumerate(misread)] + [(None, "s", 99, "the cholestesis was", "ocr", None)]
    df = spark.createDataFrame(rows, "block_id bigint, document_id string, page_number int, text string, source string, raw_id bigint")

    def repaired(most):
        return {r.block_id: (r.text, r.kinds) for r in ocr_repair.repair_scanned(df, none, most=most).collect()}

    whole = repaired(ocr_repair.MOST_WORDS)
    assert [whole[10_000 + i][0] for i in range(len(misread))] == [f"the {w} was" for w in misread.values()] and whole[None][0] == "the cholestasis was"
    # six words are frequent; the rest, or all, are in ranges of that size
    for most in (6, 2):
        assert repaired(most) == whole


def np_pairs(counts):
    import numpy as np

    out = np.zeros(ocr_repair.PAIR_BUCKETS, dtype=np.int64)
    for (a, b), n in counts.items():
        out[ocr_repair.pair_bucket(a, b)] += n
    return out


def test_truncated(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        t = " ".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) for _ in range(rnd.randint(5, 12))).capitalize() + "." for _ in range(rnd.randint(2, 12)))
        t += rnd.choice(["", "", "", "\nKeywords: alpha, beta", "\n- alpha\n- beta", "\n| a | b |", "\n* * *"])
        s = rnd.choice(["free", "limited"])
        cut = s == "limited" and len(t) > 300 or i % 10 == 0
        if s == "limited":
            t = t[:300]
        elif cut:
            t = t[: rnd.randint(len(t) // 3, len(t) * 2 // 3)] + rnd.choice(["", "…"])
        whole = t.rstrip().endswith((".", "|", "*")) or t.rstrip().endswith(("Keywords: alpha, beta", "\n- beta"))
        rows.append((i, s, t, cut and not whole))
    df = spark.createDataFrame([r[:3] for r in rows] + [(9000, "free", None), (9001, "free", ""), (9002, "free", " \n"), (9003, None, "A whole text. It ends."), (0, rows[0][1], rows[0][2])], "doc_id int, source string, text string").withColumn("near", F.lit("clash")).withColumn("cut", F.lit("clash"))
    scored = truncation.find_truncated(df, "doc_id", "source", "text")
    got = {r.doc_id: r.cut for r in scored.collect()}
    assert not {9000, 9001} & set(got) and 9003 in got
    want = {r[0]: r[3] for r in rows}
    hit = sum(got[i] for i in want if want[i])
    assert hit >= 0.93 * sum(want.values()) and hit >= 0.93 * sum(got[i] for i in want)
    limits = {r.source: (r.char_limit, r.byte_limit) for r in truncation.source_limits(df, "source", "text").collect()}
    assert limits == {"limited": (300, 300)}
    shares = {r.source: r for r in truncation.share_by_source(scored).collect()}
    assert shares["limited"]["share"] > shares["free"]["share"] > 0
    assert truncation.find_truncated(df.limit(0), "doc_id", "source", "text").count() == 0
