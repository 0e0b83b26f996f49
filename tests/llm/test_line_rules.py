import random
import re
from collections import Counter

from orderscope.llm import line_rules as R
from orderscope.llm.queries import ORACLES, QUERIES

from ..conftest import SF_SMALL
from .oracle import same


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) for k in range(3) if n[tuple(w[i:i + 3])] >= 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_query_matches_sql(spark):
    assert same(spark, QUERIES["op4_line_rules"], ORACLES["op4_line_rules"], SF_SMALL)


def test_plan_is_native_and_does_not_shuffle(spark):
    plan = QUERIES["op4_line_rules"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_base_counts_on_odd_texts(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "x " * 500, "é|#  ü　z\r\n" * 3, "\x1c \x85 \xa0"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "|", " #", "é\t"]) for _ in range(rng.randint(0, 300)))
              for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rules string")
    out = R.clean(df).collect()
    for r, t in zip(sorted(out), texts, strict=True):
        x = r.rules
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), t
        assert not (x.kept and x.base_failed)
    assert R.clean(df.limit(0)).count() == 0


def test_line_verdicts(spark):
    good = " ".join(f"word{i}, then" for i in range(40)) + "."
    cases = {
        "Home | News | About | Contact": False, "$$$ ### && value": False, "Buy!! Now!! Today!!": False,
        " ".join(f"w{i}" for i in range(10)): False, "Accept our Cookie Policy to go on.": False,
        " ".join(f"w{i}" for i in range(9)): True, "Really?! Yes!": True, "Alpha one | beta two.": True, "": True,
    }
    df = spark.createDataFrame([(i, good + "\n" + line + "\nEnd.") for i, line in enumerate(cases)], "doc_id long, text string")
    for r, (line, stays) in zip(sorted(R.clean(df).collect()), cases.items(), strict=True):
        assert r.rules.kept and r.rules.text == (good + "\n" + line + "\nEnd." if stays else good + "\nEnd."), line
    junk = spark.createDataFrame([(1, good + "\n" + "a | b | c | d\n" * 200)], "doc_id long, text string")
    x = R.clean(junk).first().rules
    assert not x.kept and x.text == good + "\n"


def test_long_running_text_is_not_lost_for_a_phrase_or_a_few_marks(spark):
    words = " ".join(f"word{i}," if i % 7 == 0 else f"word{i}" for i in range(5000))
    cases = [words + " click here.", "Yes!! " + words + " no?? well!!", "a | b | c | " + words + ".",
             "short click here, then.", "click here, " + "|" * 30]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.rules.text != "" for r in sorted(R.clean(df).collect())] == [True, True, True, False, False]
    assert [r.rules.kept for r in sorted(R.clean(df).collect())] == [True, True, True, False, False]


def test_a_line_of_a_million_marks_is_judged_in_linear_time(spark):
    import time
    R.clean(spark.createDataFrame([(1, "!?! a" * 10)], "doc_id long, text string")).collect()
    seconds = []
    for n in (250_000, 1_000_000):
        df = spark.createDataFrame([(1, "!" * n)], "doc_id long, text string")
        start = time.time()
        R.clean(df).collect()
        seconds.append(time.time() - start)
    assert seconds[1] < 8 * seconds[0] + 3
