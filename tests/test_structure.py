"""Relations, clauses, quote windows, coverage caps and isolated failures against plain versions."""

import random
import re

import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F

from corpusloom.operators import clauses, evidence, isolation, relations, windows
from corpusloom.plans import catalog, registry, structure

SF = "/root/testdata/sf0.001"


def resolved(spark, docs):
    rows = relations.lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    titles = rows.where("line = 0").select("key", "words")
    return {(r["key"], r["line"]): (r["status"], r["reason"], r["to_key"]) for r in relations.resolve(rows.where("line > 0"), titles).collect()}


def test_relations(spark):
    docs = [
        (1, "a treatise on the law of rivers\nsee the other work on bridges and roads\nnothing that is known here at all"),
        (2, "the other work on bridges and roads\na treatise on the law of rivers"),
        (3, "a twin that stands here twice\na twin that stands here twice"),
        (4, "a twin that stands here twice\nA treatise, on the law of RIVERS!\nthe other work on some quite different old things and roads"),
        (5, "an own title of some words\nan own title of some words"),
        (6, "one more that cites a twin\na twin that stands here twice"),
        (7, None),
    ]
    got = resolved(spark, docs)
    assert got == {
        (1, 1): ("resolved", None, 2), (2, 1): ("resolved", None, 1), (3, 1): ("resolved", None, 4), (4, 1): ("resolved", None, 1),
        (4, 2): ("unresolved", "LOW_SCORE", None), (5, 1): ("unresolved", "SELF_REFERENCE", None), (6, 1): ("unresolved", "AMBIGUOUS", None),
    }


def test_relations_margin(spark):
    """A rival within the margin leaves a mention open."""
    docs = [(1, "alpha beta gamma delta one"), (2, "alpha beta gamma delta two"), (3, "another text of four words\nalpha beta gamma delta three"), (4, "a last text of words\nalpha beta gamma delta two")]
    got = resolved(spark, docs)
    assert got[(3, 1)][:2] == ("unresolved", "LOW_SCORE") and got[(4, 1)] == ("resolved", None, 2)


def plain_tree(text):
    """Parents and paths by a stack."""
    stack, out, at = [], [], 0
    for line in text.split("\n"):
        hit = re.match(r"\s*(\d{1,3}(?:\.\d{1,3})*)\. ", line)
        if hit and not re.match(r"\s*\d{1,2}[./]\d{1,2}[./]\d{2,4}", line):
            level = hit[1].count(".") + 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append((hit[1], stack[-1][2] if stack else None, "/".join([s[1] for s in stack] + [hit[1]]), at))
            stack.append((level, hit[1], len(out)))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_equals_stack(spark, seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(20):
        lines = []
        for _ in range(rnd.randrange(40)):
            number = ".".join(str(rnd.randrange(1, 30)) for _ in range(rnd.choice([1, 1, 2, 2, 3, 4, 6])))
            lines.append(rnd.choice([f"{number}. word é🙂", "plain words", "", f"{number}. Title"]))
        texts.append("\n".join(lines))
    got = clauses.clause_tree(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in got if r["key"] == i), key=lambda r: r["clause"])
        assert [(r["number"], r["parent"], r["path"], r["start"]) for r in own] == plain_tree(text)
        for r in own:
            inside = [x["clause"] for x in own if r["start"] < x["start"] < r["subtree_stop"]]
            assert inside == [x["clause"] for x in own if x["path"].startswith(r["path"] + "/") and r["start"] < x["start"] < r["subtree_stop"]]
            assert r["start"] < r["stop"] <= r["subtree_stop"] <= len(text)


@pytest.mark.parametrize(
    ("line", "number"),
    [
        ("Madde 5 - Kira bedeli", "5"), ("MADDE 5.2: ÜCRET", "5.2"), ("Article 12. Scope", "12"), ("§ 3 Haftung", "3"), ("5) Text", "5"), ("5- Text", "5"), ("5.2 Fees", "5.2"), ("  7. x", "7"),
        ("5.2 fees", None), ("12.03.2024 tarihinde", None), ("30. gün içinde", None), ("2.500. TL", None), ("30 gün içinde", None), ("Madde 5'te", None), ("1.1.1.1.1.1.1. deep", None), ("", None),
    ],
)
def test_marker(spark, line, number):
    got = spark.createDataFrame([(line,)], "x string").select(clauses.marker(F.col("x"))["number"].alias("n")).first()["n"]
    assert got == number


def test_titles_and_sections(spark):
    text = "LEASE\n1. Parties\ntext\nRENT\n2. The rent is due.\nSPECIAL TERMS\n1. GARDEN\n2. Keys"
    got = {r["clause"]: (r["title"], r["section"]) for r in clauses.clause_tree(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert got == {1: (None, None), 2: ("RENT", None), 3: ("GARDEN", "SPECIAL TERMS"), 4: (None, "SPECIAL TERMS")}


def plain_window(text, words, most):
    """Best window by trying each match's window in turn, then without cut words."""
    if len(text) <= most:
        return 0, text
    found = [m.start() for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in words]
    starts = sorted({max(0, min(p - most // 3, len(text) - most)) for p in found}) or [0]
    start = max(starts, key=lambda s: (sum(s <= p < s + most for p in found), -s))
    a, b = start, start + most
    while a < b and a > 0 and not text[a - 1].isspace():
        a += 1
    while b > a and b < len(text) and not text[b].isspace():
        b -= 1
    body = text[a:b].strip()
    return (text.index(body, a), body) if body else (start, text[start : start + most])


def test_windows_equal_plain(spark):
    rnd = random.Random(3)
    texts = ["", "x", "w" * 200, "é" * 90 + " law " + "é" * 90]
    texts += [" ".join(rnd.choice(["law", "river", "Law", "the", "a", "bridge.", "laws", "été\n"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    questions = [(1, ["law"]), (2, ["river", "été"])]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id bigint, text string")
    got = {(r["key"], r["question"]): (r["start"], r["quote"]) for r in windows.quote_windows(docs, questions, 40).collect()}
    assert len(got) == 2 * len(texts)
    for i, text in enumerate(texts):
        for q, words in questions:
            assert got[(i, q)] == plain_window(text, words, 40), (text, words)


def plain_cap(rows, cap):
    """The swaps of a full scan that starts again after each swap."""
    kept, dropped = rows[:cap], rows[cap:]
    while True:
        union = set().union(*[r[1] for r in kept])
        for d, row in enumerate(dropped):
            if not row[1] - union:
                continue
            at = next((k for k in range(len(kept) - 1, -1, -1) if not kept[k][2] and kept[k][1] <= set().union(*[r[1] for i, r in enumerate(kept) if i != k])), None)
            if at is not None:
                kept[at], dropped[d] = row, kept[at]
                break
        else:
            return {r[0] for r in kept}


def test_cap_equals_plain(spark):
    rnd = random.Random(5)
    groups = {g: [(n + 1, {w for w in range(8) if rnd.random() < 0.25}, n == 0) for n in range(rnd.randrange(1, 40))] for g in range(60)}
    rows = [(g, n, sum(1 << w for w in words), pinned) for g, held in groups.items() for n, words, pinned in held]
    got = windows.coverage_cap(spark.createDataFrame(rows, "group_id bigint, rank bigint, bits bigint, pinned boolean"), 5).where("kept").collect()
    for g, held in groups.items():
        assert {r["rank"] for r in got if r["group_id"] == g} == plain_cap(held, 5)


def test_cap_query(spark):
    rows = structure.lm_coverage_cap(spark, SF).collect()
    for source in {r["source"] for r in rows}:
        held = [(r["rank"], {w for w in range(63) if r["bits"] >> w & 1}, r["rank"] == 1) for r in sorted((r for r in rows if r["source"] == source), key=lambda r: r["rank"])]
        assert {r["rank"] for r in rows if r["source"] == source and r["kept"]} == plain_cap(held, 8)


def test_words_of_a_question_are_found_once(spark):
    """Equal to all words of odd texts; worked out once a text, and the ranked rows are read once."""
    rnd = random.Random(8)
    asked = ["the", "then", "le", "les", "été", "straße"]
    texts = ["", None, *["".join(rnd.choice([*asked, "THE", "ÉTÉ", "İ", "\u0301", "\U00010400", " ", " ", "-", "7", "_", "s", "\n"]) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    question = F.array(*[F.lit(w) for w in asked])
    every = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    both = rows.select(windows.lexeme_bits(windows.words_among(F.lower("text"), asked), question).alias("few"), windows.lexeme_bits(every, question).alias("all"))
    got = both.collect()
    assert all(r["few"] == r["all"] for r in got) and len({r["few"] for r in got}) > 20
    assert "array_contains(lambda" in both._jdf.queryExecution().optimizedPlan().toString()
    cap = structure.lm_coverage_cap(spark, SF)
    assert cap.count() == cap.select("doc_id").distinct().count()
    cap.collect()
    assert "ReusedExchange" in cap._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_isolation(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "-1")], "id int, n string")
    n = F.expr("try_cast(n as int)")
    done = isolation.isolate(df, F.struct(n.alias("n")), [("NOT_A_NUMBER", n.isNull(), F.col("n")), ("NEGATIVE", n < 0, n)], ["id"])
    good, bad = isolation.split(done, "test")
    assert [tuple(r) for r in good.collect()] == [(1, 5)]
    assert {tuple(r) for r in bad.collect()} == {(2, "NOT_A_NUMBER", "x"), (3, "NOT_A_NUMBER", None), (4, "NEGATIVE", "-1")}


def test_caption_above_the_first_whole_number(spark):
    """Without a whole number before it, a caption is a title: the numbering does not start again."""
    rows = spark.createDataFrame([(1, "1.1. one\nCAPTION\n4. four\nOTHER\n4. again")], "doc_id int, text string")
    got = [(r["title"], r["section"]) for r in clauses.clause_tree(rows).orderBy("clause").collect()]
    assert got == [(None, None), ("CAPTION", None), (None, "OTHER")]


def test_candidates_of_a_common_block(spark):
    """Mentions and entries that all share an end: the best three of all, and no row a pair on the way."""
    rnd = random.Random(6)
    text = lambda n: [rnd.choice("abcdefgh") for _ in range(n)] + ["in", "common", "end"]
    named, mentioned = [sorted({tuple(text(rnd.randrange(1, 9))) for _ in range(300)}) for _ in range(2)]
    e = spark.createDataFrame([(list(t), i % 4 + 1, i, i + 1) for i, t in enumerate(named)], "words array<string>, n_bearers int, low int, high int")
    m = spark.createDataFrame([(list(t),) for t in mentioned], "words array<string>")
    found = relations.candidates(m, e)
    got = {tuple(r["words"]): [(x["score"], tuple(x["title"])) for x in r["found"]] for r in found.collect()}

    def score(a, b):
        shared, either = len(set(a) & set(b)), len(set(a) | set(b))
        return round(0.6 * shared / either + 0.2 * min(len(a), len(b)) / max(len(a), len(b)) + 0.1 * (a[:3] == b[:3]) + 0.1 * (a[-3:] == b[-3:]), 6)

    for t in mentioned:
        want = sorted((-score(t, u), u) for u in named)[:3]
        assert [(round(-s, 5), u) for s, u in got[t]] == [(round(s, 5), u) for s, u in want]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "bundle" in plan


def test_quotes_meet_texts_without_shuffling_them(spark):
    """States of quotes against a plain version; a run counts once a text, and whole texts are not shuffled."""
    rnd = random.Random(9)
    texts = ["", None, "a b c a b c a b c", "A, b; c", *[" ".join(rnd.choice("abcdÉ") for _ in range(rnd.randrange(0, 30))) for _ in range(40)]]
    quotes = ["zz", "a b c", "a b", "zz zz zz zz zz", "A b c a b c", *[" ".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9))) for _ in range(40)]]

    def runs(words):
        return [x for x in (" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))) if x]

    listed = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    want = {}
    for k, quote in enumerate(quotes):
        words = re.findall(r"[^\W_]+", quote.lower())
        own = set(runs(words))
        n, d = max((len(own & set(runs(w))), -i) for i, w in enumerate(listed))
        held = f" {' '.join(listed[-d])} "
        share = n / len(own)
        state = "MISSING" if not n else "VERBATIM" if quote in texts[-d] else "FOLDED" if f" {' '.join(words)} " in held else "ALTERED" if share >= 0.5 else "MISSING"
        want[k] = (-d if state != "MISSING" else None, state, round(share, 6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = evidence.quote_states(docs, spark.createDataFrame(list(enumerate(quotes)), "item_id bigint, text string"))
    assert {r["item_id"]: (r["doc_id"], r["state"], r["share"]) for r in found.collect()} == want
    once = evidence.run_rows(spark.createDataFrame([(1, "a b c d e".split()), (2, ["a"]), (3, []), (4, None)], "d int, words array<string>"))
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a b c d"), (1, "b c d e"), (2, "a")]
    states = catalog.ev_altered_quotes(spark, SF)
    states.collect()
    plan = states._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"LeftSemi, BuildRight(.|\n)*FileScan parquet \[d#", plan), "ids of the best texts are read where their number is known"


def test_clauses_of_odd_lines_equal_their_sql(spark, tmp_path):
    """Addresses, markers of other kinds, wide blanks and ends of lines within a line are read as the SQL reads them."""
    rnd = random.Random(12)
    starts = ["123.45.67.89 Den", "Section 3 of", "1) it", "12.03.24. on", "2.500. TL", "5.2 Fees", "§ 3", "7. GÜN", "7. Gün", "9.Kat", "4. ſaat", "", "TITLE", " ", "　", " TITLE　", "A B", "A\x0bB", "1. a\rb", "3. X"]
    ends = ["", " ", "\r", " ", "\u0085", " ", "\t", "\x0b", " word", " WORD"]
    line = lambda: rnd.choice(starts) + rnd.choice(ends) + rnd.choice(["", " ", "x", "XY", "XYZ", "É"])
    texts = ["\n".join(line() for _ in range(rnd.randrange(30))) for _ in range(300)]
    rows = [*enumerate(texts), (1000, None), (None, "TITLE\nab"), (1001, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(spark, con, str(tmp_path), "ps_clauses", structure.ps_clauses, registry.oracle_sql()["ps_clauses"]) is None
    found = structure.ps_clauses(spark, str(tmp_path)).where("number like '123%' or number = '5.2'")
    assert found.count() == 0 and len(texts) == 300


def test_relations_equal_their_sql_at_halves(spark, tmp_path):
    """Scores that lie at half a millionth are rounded as in SQL; ids may repeat."""
    rows = []
    for n, (a, b, shared) in enumerate([(71, 80, 23), (59, 100, 31), (45, 120, 37), (89, 128, 7)]):
        ends = [f"e{n}x{i}" for i in range(shared)]
        title, line = [" ".join([f"{c}{n}x{i}" for i in range(size - shared)] + ends) for c, size in (("t", a), ("l", b))]
        rows += [(2 * n, title), (2 * n + 1, f"another title of text {n}\n{line}\nshort line\n{line} more words\n{title}")]
    rows += [(1, "\nfirst in no line but this\na second line of it"), (20, None), (21, ""), (22, "one more that is\nan own title here\nan own title here")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("ig_write_relations", "ig_relation_edges"):
        assert differences(spark, con, str(tmp_path), name, getattr(structure, name), registry.oracle_sql()[name]) is None
    assert structure.ig_write_relations(spark, str(tmp_path)).where("reason = 'LOW_SCORE'").count() >= 4


def test_pairs_of_a_block_are_scored_once(spark):
    """Shared words are counted once a pair, of hashed sets, and a large block is dealt over bundles."""
    text = lambda i: [f"w{i}", f"v{i % 7}", "in", "common", "end"]
    e = spark.createDataFrame([(text(i), 1, i, i) for i in range(300)], "words array<string>, n_bearers int, low int, high int")
    found = relations.candidates(spark.createDataFrame([(text(i),) for i in range(40)], "words array<string>"), e)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1
    assert all(r["found"][0]["title"] == r["words"] and r["found"][0]["score"] == 1.0 for r in found.collect())
