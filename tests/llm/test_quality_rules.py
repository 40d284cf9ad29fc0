import re
from collections import Counter

from checktool import SF_DIR, compare, connection
from hypothesis import given, settings, strategies as st

from crosstide.llm import catalogue, quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, _measures int"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))


def frame(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


def check(spark, texts):
    got = {r.doc_id: r for r in Q.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_base_measures(spark):
    check(spark, [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\nx \n y\n\ty", "é\xa0b #*$%&|<> 漢 😀😀",
                  "w " * 20_000, " ".join(str(i % 700) for i in range(5000)), "a\x0bb\x0cc\rd", "\x1ca\x1c", "1 2 3 4 1 2 3 9 2 3 4"])


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", "#", " "]), max_size=40), min_size=1, max_size=6))
@settings(max_examples=5, deadline=None)
def test_base_measures_of_any_text(spark, texts):
    check(spark, [" ".join(t) for t in texts])


def test_whole_table_equals_sql(spark):
    got = catalogue.QUERIES["op2_quality_rules"](spark, SF_DIR).toPandas()
    assert compare(got, connection().execute(Q.SQL).df()) == ""


def clean(i, n=80):
    return " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(n))


def test_thresholds_follow_the_group(spark):
    # symbols are usual in one source: there they do not reject, elsewhere they do
    code = [clean(i) + " {} ".format("# " * 20) for i in range(250)]
    prose = [clean(i) for i in range(250)]
    rows = [(i, t, "en", "code", "", "", 0) for i, t in enumerate(code)] + [(1000 + i, t, "en", "prose", "", "", 0) for i, t in enumerate(prose)]
    rows.append((5000, code[0], "en", "prose", "", "", 0))
    kept = {r.doc_id: r.kept for r in Q.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[5000] and all(v for k, v in kept.items() if k != 5000)


def test_small_group_uses_the_language(spark):
    rows = [(i, clean(i), "en", "big", "", "", 0) for i in range(300)] + [(900, clean(3), "en", "tiny", "", "", 0), (901, clean(4) + " #" * 90, "en", "tiny", "", "", 0)]
    kept = {r.doc_id: r.kept for r in Q.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[900] and not kept[901]


def test_filter_keeps_columns_and_repeats(spark):
    rows = [(1, clean(1), None, None, "p", "q", 7), (1, clean(1), None, None, "p", "q", 7), (2, "short", None, "s", "p", "q", 7), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[0]]
    assert Q.keep_good(docs.limit(0)).count() == 0 and Q.report(docs.limit(0)).count() == 0


def test_sketches_merge():
    # a bucket keeps seven leading bits: exact below 128, within 1/64 above
    for v in (0, 1, 127, 128, 1000, 12345):
        drop = max(len(bin(v)) - 2 - Q.LEADING_BITS, 0)
        assert v - v % (1 << drop) <= v < (v - v % (1 << drop)) * (1 + 1 / 64) + 1
