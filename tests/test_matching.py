import random

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions.text import clean_markup, count_in_set, fixed, normalise, numeral_year, translate_script
from stanzaflow.operators import density, lexicon as lx, matching as mt
from stanzaflow.operators.lexicon import Entry, Lexicon


def plain(text, lexicon):
    """The rule by itself: forms in order, left to right, no character twice."""
    used, out = [False] * len(text), []
    for _, form, entry in lexicon.ordered():
        at = text.find(form)
        while at >= 0:
            if any(used[at : at + len(form)]):
                at = text.find(form, at + 1)
            else:
                used[at : at + len(form)] = [True] * len(form)
                out.append((entry.id, at))
                at = text.find(form, at + len(form))
    return out


def random_lexicon(rng):
    forms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(9)}
    forms = sorted(forms, key=lambda f: rng.random())
    return Lexicon(tuple(Entry(f"e{i}", tuple(forms[i::4]), f"c{i % 2}", (i + 1) / 4) for i in range(4) if forms[i::4]))


@pytest.mark.parametrize("seed", range(4))
def test_both_plans_equal_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    lexicon = random_lexicon(rng)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(300)] + [(900, "abcab" * 200)]
    df = spark.createDataFrame(rows, "id long, t string")
    order = mt.entries_hit(mt.fold(F.col("t"), lexicon)).alias("order")
    got = df.select("id", mt.detect(F.col("t"), lexicon, "a-z").alias("m"), order).collect()
    positions = {}
    for r in mt.match_by_grams(df, "id", "t", lx.form_table(lx.table(spark, lexicon))).collect():
        positions.setdefault(r.id, []).append((r.entry_id, r.pos))
    weight = {e.id: e.specificity for e in lexicon.entries}
    for (i, t), r in zip(rows, got, strict=True):
        want = plain(t, lexicon)
        counts = {}
        for e, _ in want:
            counts[e] = counts.get(e, 0) + 1
        assert r.m.n_chars == len(t) and r.m.raw_tokens == len(want)
        assert r.m.entries_hit == counts and r.order == list(counts)
        assert r.m.weighted_presence == pytest.approx(sum(weight[e] for e in counts))
        assert sorted(positions.get(i, [])) == sorted(want)


LONG = Lexicon((Entry("a", ("AB",), "x", 0.5), Entry("b", ("BCDE",), "y", 0.9), Entry("c", ("CD",), "x", 0.9)))


def test_filters_act_before_matching_and_categories_after(spark):
    df = spark.createDataFrame([("A-B C!DE",), (None,), ("",)], "t string")
    full, short = (df.select(mt.detect(F.col("t"), k, "A-Z").alias("m")).collect() for k in (LONG, LONG.keep(0.0, ["y"])))
    assert full[0].m.entries_hit == {"b": 1} and short[0].m.entries_hit == {"a": 1, "c": 1}
    assert full[1].m.n_chars == 0 and full[2].m.raw_tokens == 0
    cells = {(r.category): r.value for r in density.category_values(df.limit(1), "t", LONG, "A-Z").collect()}
    assert cells == {"x": 0.0, "y": 0.9}
    configs = [("all", 0.0, (), "weighted"), ("without y", 0.0, ("y",), "tokens")]
    assert {r.config: r.value for r in density.scored_by_configs(df.limit(1), "t", LONG, configs, "A-Z").collect()} == {"all": 0.9, "without y": 2.0}


def test_dual_score_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ABCDE國", 99, "old"), (2, None, 98, "old")], "id int, t string, n_chars int, signal_entries string")
    got = mt.with_dual_score(df, "t", LONG, LONG, 0.6, keep="A-Z國").orderBy("id").collect()
    assert (got[0].n_chars, got[0].signal_entries, got[0].control_tokens) == (6, ["b"], 1)
    assert got[0].signal_density100 == pytest.approx(15) and got[0].control_density100 == pytest.approx(100 / 6)
    assert (got[1].n_chars, got[1].signal_density100, got[1].control_density100) == (0, 0.0, 0.0)


def test_equal_lengths_match_in_file_order(spark):
    for forms, want in ((("ab", "bc"), "x"), (("bc", "ab"), "x")):
        k = Lexicon((Entry("x", (forms[0],), "c"), Entry("y", (forms[1],), "c")))
        assert spark.createDataFrame([("abc",)], "t string").select(mt.detect(F.col("t"), k, "a-z")["entries_hit"]).first()[0] == {want: 1}


def test_contains_count(spark):
    got = spark.createDataFrame([("aab!",), (None,)], "t string").select(mt.contains_count(F.col("t"), ["aa", "a", "b!", "c"])).collect()
    assert [r[0] for r in got] == [3, 0]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "a國，𠀀豈b㐀", normalise) == "國豈㐀" and one(spark, None, normalise) == ""
    assert one(spark, "一八九五年", numeral_year) == 1895 and one(spark, "一○五", numeral_year) is None
    assert one(spark, "矣x也矣", lambda c: count_in_set(c, "矣也")) == 3
    assert one(spark, "{{header\n|a}}b{{x{{y}}}}[[c|d]][[e]]<br/>f（按g）h", clean_markup) == "bde\nfh"
    assert one(spark, "后台台风", lambda c: translate_script(c, "台风", "臺風")) == "后臺臺風"


def test_script_conversion_by_phrases(spark):
    rows = [(1, "后台台风"), (2, None), (3, ""), (4, "\ue000台\ue001后台\uf900𠀀后"), (5, "发头发发头"), (6, "台" * 3000 + "头发")]
    phrases = spark.createDataFrame([("后台", "後臺"), ("头发", "頭髮"), ("发头", "X"), ("发", "發"), ("", "no"), ("头发", "頭髮髮")], "form string, becomes string")
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.t for r in mt.convert_script(df, "id", "t", "台风", "臺風", phrases).collect()}
    assert got == {1: "後臺臺風", 2: None, 3: "", 4: "\ue000臺\ue001後臺\uf900𠀀后", 5: "X發X", 6: "臺" * 3000 + "頭髮"}
    many = spark.createDataFrame([(chr(0x4E00 + i) + chr(0x4E01 + i), f"<{i}>") for i in range(7000)], "form string, becomes string")
    long = spark.createDataFrame([(1, chr(0x4E00 + 6999) + chr(0x4E01 + 6999))], "id long, t string")
    assert mt.convert_script(long, "id", "t", "a", "b", many).first().t == "<6999>"


def test_fixed_rounds_as_the_exact_binary_value(spark):
    xs = [0.0625, 0.1875, 0.0005, 0.0015, 2.675, 1.0005, -0.0625, 0.0, 123.4565, 5e-5, 99999.9995, 0.3125]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(fixed(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:.3f}" for x in xs]


def test_grams_meet_forms_where_they_are_and_only_occurrences_are_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    lexicon = Lexicon((Entry("a", ("ab", "abcab", "cc"), "x"), Entry("b", ("bca", "c" * 300, "ab"), "y")))
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(600)))) for i in range(40)] + [(900, "c" * 1000), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    forms = lx.form_table(lx.table(spark, lexicon))
    monkeypatch.setattr(mt, "PIECE", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mt.match_by_grams(df, "id", "t", forms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        here = plan[: plan.index("Generate explode(sequence(1")]
        assert "SortMergeJoin" not in here and "BroadcastHashJoin" in here
        got = sorted(tuple(r) for r in found.collect())
        monkeypatch.setattr(mt.automaton, "BROADCAST_CHARS", 0)  # beyond it, the same by a shuffled join
        assert sorted(tuple(r) for r in mt.match_by_grams(df, "id", "t", forms).collect()) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(i, e, at) for i, t in rows for e, at in plain(t or "", lexicon)]
    assert sorted((i, e, at) for i, _, e, at in got) == sorted(want)


def test_weights_are_added_in_the_lexicon_s_order(spark):
    """0.1 + 0.7 + 0.3 and its other orders differ in the last bit, which shows where three decimals are a tie."""
    lexicon = Lexicon((Entry("x", ("a",), "c", 0.1), Entry("y", ("bbb",), "c", 0.7), Entry("z", ("dd",), "c", 0.3)))
    df = spark.createDataFrame([("addbbb",), ("bbbdda",), ("ddbbb",)], "t string")
    got = [r[0] for r in df.select(mt.weighted_presence(mt.fold(F.col("t"), lexicon), lexicon)).collect()]
    assert got == [0.1 + 0.7 + 0.3] * 2 + [0.7 + 0.3] and 0.1 + 0.7 + 0.3 != 0.7 + 0.3 + 0.1
