import collections
import random

import pytest
from pyspark.sql import functions as F

from foliomill.llm import bpe, repeated_lines, splitting

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_split(spark):
    rnd, rows = random.Random(1), []
    seps = [" ", " ", "\n", "\n\n", " ", "　", ". ", ", ", "\t"]
    for i in range(80):
        rows.append((i, "".join(f"w{j}" + rnd.choice(seps) for j in range(rnd.randint(0, 60))), rnd.randint(1, 12), rnd.randint(0, 11), "x"))
    rows += [(90, None, 5, 1, None), (91, " \n ", 5, 1, None), (92, "a b c", None, 1, None), (93, "a b c d", 2, None, None), (94, "a b c d", 2, -3, None), (95, "a " * 5000, 7, 3, None), (96, "a b c d", 0, 0, None), (97, "x" * 5000 + " b", 1, 5, None), (97, "x" * 5000 + " b", 1, 5, None)]
    # names that the operator uses itself
    df = spark.createDataFrame(rows, "id int, text string, lim int, lap int, parts string")
    got = collections.defaultdict(list)
    for r in splitting.split_oversized(df, "text", "lim", "lap").collect():
        got[r.id].append(r)
    for i, text, lim, lap, _ in rows[:-1]:
        want = [w[j : j + splitting.TOKEN_CHARS] for w in (text or "").split() for j in range(0, len(w), splitting.TOKEN_CHARS)]
        ps = sorted(got.get(i, []), key=lambda r: r.piece_no)
        if i == 97:
            ps = ps[::2]
        most = lim if lim and lim >= 1 else max(len(want), 1)
        over = min(max(lap or 0, 0), most - 1)
        fresh, before = [], None
        for p in ps:
            toks = p.piece.split()
            assert len(toks) == p.token_count <= most and toks == want[p.first_token : p.first_token + len(toks)]
            if before is not None:
                assert p.overlap_count == over and before[len(before) - over :] == toks[:over]
            fresh += toks[p.overlap_count :]
            before = toks
        assert fresh == want
    assert splitting.split_oversized(df.limit(0), "text", "lim", "lap").count() == 0


def test_split_prefers_strong_boundaries(spark):
    df = spark.createDataFrame([("a b c d e.\n\nf g h i j k", 8, 0), ("a b c d. e f g h i j", 6, 0), ("a b c d\ne f. g h i j", 7, 0)], "text string, lim int, lap int")
    first = [r.piece for r in splitting.split_oversized(df, "text", "lim", "lap").where("piece_no = 0").collect()]
    assert first == ["a b c d e.", "a b c d.", "a b c d"]


def test_oversized(spark):
    blocks = spark.createDataFrame([(1, "d", "w " * 200, 0), (1, "d", "w " * 200, 0), (2, "d", "w " * 128, 0), (3, "none", "w " * 500, 0), (4, "d", None, 0), (5, None, "w " * 500, 0), (6, "e", "w " * 200, 0)], "block_id int, document_id string, text string, config_id int")
    jobs = spark.createDataFrame([("d", 1), ("d", 1), ("e", 2), (None, 1), ("f", None)], "document_id string, config_id int")
    configs = spark.createDataFrame([(1, 128, 10), (2, 256, 10)], "config_id int, max_chunk_tokens int, chunk_overlap_tokens int")
    assert [r.block_id for r in splitting.oversized(blocks, jobs, configs).collect()] == [1]


def test_repeated_lines(spark):
    rows = []
    for d in range(6):
        for p in range(12):
            rows.append((d * 1000 + p, f"d{d}", p, f"text of page {p} in {d} about {'abcdefghijkl'[p] * 12}\nPage {p} - Journal of Things"))
        rows.append((d * 1000 + 50, f"d{d}", 3, "THE USUAL NOTICE 99\nshort"))
    for p in range(4):
        rows.append((7000 + p, "e", p, f"THE usual notice {p}\nline of {'wxyz'[p] * 9}"))
        rows.append((7100 + p, "e", 0, "only on one page, often"))
    rows += [(8000, None, 1, "Page 1 - Journal of Things"), (8001, "d0", None, "Page 1 - Journal of Things"), (8002, "d0", 1, None), (8003, "d0", 1, ""), rows[0]]
    df = spark.createDataFrame(rows, "block int, source string, page int, line string")
    got = {(r.block, r.line_no) for r in repeated_lines.lines_to_remove(df, "source", "page", "block", "line").collect()}
    pages = collections.defaultdict(set)
    lines = []
    for b, s, p, t in rows:
        for i, x in enumerate((t or "").split("\n"), 1):
            k = "".join(c for c in x.lower() if c.isalpha())
            if s is not None and len(k) >= 10:
                lines.append((b, i, s, k))
                if p is not None:
                    pages[s, k].add(p)
    assert got == {(b, i) for b, i, s, k in lines if len(pages[s, k]) >= 4}
    clean = {r.block: (r.text, r.removed) for r in repeated_lines.remove_repeated(df, "source", "page", "block", "line").collect()}
    assert clean[0] == (rows[0][3].split("\n")[0], 1) and clean[8002] == (None, 0) and clean[8003] == ("", 0)
    assert repeated_lines.lines_to_remove(df.limit(0), "source", "page", "block", "line").count() == 0


def test_bpe(spark):
    import os

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    real = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["", None, "<|endoftext|> a", "the" * 3000, "ab" * 4000, " \n\t  ", "日本語 🙂 é", "\x00\x01", "I've they'LL we're"]
    texts += ["".join(rnd.choice("etaoin shrdlu'é1-\n") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "ids int, text string")
    coded = bpe.encode_texts(df.withColumnRenamed("ids", "k"), "k", "text", VOCABULARY)
    assert {r.k: r.ids for r in coded.collect()} == {i: real.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.k: r.text for r in bpe.decode_ids(coded, "k", "ids", VOCABULARY).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_texts(df.limit(0), "ids", "text", VOCABULARY).count() == 0
    assert df.where(F.col("text").isNull()).count() == 1


def test_repeated_lines_of_a_hot_source_and_of_all_sources(spark):
    word = lambda n: "".join(chr(97 + int(c)) for c in f"{n:04d}")
    # a source with a third of all pages has a line on 4 of them; a notice is on 4 pages of every source
    rows = [(p, "hot", p, f"own words of page {word(p)} here" + ("\nA line of the hot source" if p < 4 else "") + ("\nThe notice of all sources" if p < 4 else "")) for p in range(300)]
    rows += [(1000 + 60 * d + p, f"d{d}", p, f"own words of page {word(1000 + 60 * d + p)} here" + ("\nThe notice of all sources" if p < 4 else "")) for d in range(10) for p in range(60)]
    df = spark.createDataFrame(rows, "block int, source string, page int, line string")
    found = repeated_lines.lines_to_remove(df, "source", "page", "block", "line").collect()
    want = {(b, i) for b, _, _, t in rows for i in range(2, t.count("\n") + 2)}
    assert {(r.block, r.line_no) for r in found} == want and len(found) == len(want)
    assert not all(r.significant for r in found)


def test_text_without_white_space_is_cut_by_characters(spark):
    long = "x" * 100_000
    df = spark.createDataFrame([(1, long, 4, 1), (2, "a " + long + " b", 4, 0), (3, long, None, 1)], "id int, text string, lim int, lap int")
    got = {}
    for r in splitting.split_oversized(df, "text", "lim", "lap", token_chars=1000).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r)
    assert all(len(r.piece) <= 4 * 1000 + 3 and r.token_count <= 4 for i in (1, 2) for r in got[i]) and len(got[3]) == 1
    assert "".join(r.piece[r.overlap_count * 1000 :] for r in got[1]) == long
    assert got[2][0].piece.startswith("a x") and got[2][-1].piece.endswith("x b")


def lines(rows):
    return [(d, p, i, t) for i, (d, p, t) in enumerate(rows)]


def test_cases_do_not_depend_on_other_sources(spark):
    notice, own = "Share this article with your friends", "A line that one source alone repeats"
    one = [("s", p, own if p < 4 else f"{chr(97 + p % 26) * 12} {chr(97 + p // 26) * 3}") for p in range(40)]
    big = [("big", p, own if p < 4 else f"{chr(97 + p % 26) * 12}{chr(97 + p // 26 % 26) * 3} text") for p in range(1000)]
    many = [(f"d{d}", p, notice if p < 4 else f"{chr(97 + d % 26) * 10}{chr(97 + d // 26) * 4}{chr(97 + p) * 5}") for d in range(250) for p in range(6)]
    for rows, least in ((one, 4), (big + many, 4 + 1000)):
        df = spark.createDataFrame(lines(rows), "document_id string, page int, id int, text string")
        got = repeated_lines.lines_to_remove(df, "document_id", "page", "id", "text").collect()
        want = {i for _, _, i, t in lines(rows) if t in (notice, own)}
        assert want <= {r.block for r in got} and len(want) == least
        score = {r.block: r.log10_p for r in got}
        assert len(rows) == 40 or all(score[i] < 0 for i in want if lines(rows)[i][3] == own)
