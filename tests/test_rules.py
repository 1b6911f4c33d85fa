from pyspark.sql import functions as F

from tidymill.functions.dates import duration_days, parse_date, parse_time
from tidymill.functions.fixed_values import AMOUNT_WORD_TYPOS
from tidymill.functions.numbers import parse_number, spoken_number
from tidymill.functions.text import title_letters
from tidymill.operators import contact, duplicates, identity, numeric, organisation
from tidymill.operators.rules import apply_rules


def values(spark, items, expr):
    df = spark.createDataFrame(list(enumerate(items)), "_rid int, v string")
    return [r[0] for r in df.select("_rid", expr(F.col("v")).alias("x")).orderBy("_rid").select("x").collect()]


def test_numbers_as_text(spark):
    cases = {"$1,234.50": 1234.5, "1.234,56 EUR": 1234.56, "12,5": 12.5, "USD 7": 7.0, "1e3": 1000.0, "free": None, "-3": -3.0, None: None}
    assert values(spark, list(cases), parse_number) == list(cases.values())


def test_number_words(spark):
    cases = {"one hundred and twenty-five": 125.0, "two thousand three": 2003.0, "fourty": 40.0, "five bananas": None, "twentieth": 20.0, "one million": 1e6}
    assert values(spark, list(cases), lambda v: spoken_number(v, AMOUNT_WORD_TYPOS, ordinals=True)) == list(cases.values())


def test_dates(spark):
    cases = {"2024-02-29": "2024-02-29 00:00:00", "2023-02-29": None, "03/04/2024": "2024-04-03 00:00:00", "12/25/2024": "2024-12-25 00:00:00", "1st Mar 2021": "2021-03-01 00:00:00",
             "March 5, 2020 3:07 pm": "2020-03-05 15:07:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "later": None, "20240131": "2024-01-31 00:00:00", "1-1-99": "1999-01-01 00:00:00"}
    got = values(spark, list(cases), lambda v: F.date_format(parse_date(v, True, 2024), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(cases.values())
    assert values(spark, ["03/04/2024"], lambda v: F.date_format(parse_date(v, False, 2024), "yyyy-MM-dd")) == ["2024-03-04"]


def test_times_and_durations(spark):
    cases = {"3:05 PM": "15:05:00", "12 am": "00:00:00", "7": None, "24:00": None, "9:5:7": "09:05:07", "12:30 p.m.": "12:30:00"}
    assert values(spark, list(cases), parse_time) == list(cases.values())
    cases = {"2 weeks 3 days": 17.0, "1:30": 0.0625, "two hours": round(2 / 24, 9), "soon": None}
    assert values(spark, list(cases), lambda v: F.round(duration_days(v), 9)) == list(cases.values())


def test_title_after_any_non_letter(spark):
    assert values(spark, ["o'brien-smith 3rd", "éCOLE"], title_letters) == ["O'Brien-Smith 3Rd", "École"]


def test_barcodes(spark):
    cases = {"4006381333931": True, "4006381333932": False, "036000291452": True, "96385074": True, "123": None}
    assert values(spark, list(cases), organisation.check_digit_ok) == list(cases.values())


EMAILS = [" A@GMIAL.com", "x@y.org; z@w.net", "test@test.com", None, "bad", "dup@a.com", "DUP@a.com"]


def _emails(spark, parts=3):
    df = spark.createDataFrame(list(enumerate(EMAILS)), "_rid int, email string").repartition(parts)
    return apply_rules(df, [contact.email_rules("email")])


def test_flags_never_change_data_and_audit_matches_changes(spark):
    res = _emails(spark)
    table = {r._rid: r.email for r in res.table.collect()}
    assert table == {0: "a@gmial.com", 1: "x@y.org", 2: None, 3: None, 4: "bad", 5: "dup@a.com", 6: "dup@a.com"}
    flags = {(r.rule, r._rid) for r in res.flags.collect()}
    assert {("EMAIL-10", 0), ("EMAIL-02", 4), ("EMAIL-08", 2), ("EMAIL-08", 3), ("EMAIL-04", 5), ("EMAIL-04", 6)} == flags
    # the last audited value of a cell is the value in the table, the first old value is the original
    audit = [r for r in res.audit.collect()]
    assert {r._rid for r in audit} == {i for i, e in enumerate(EMAILS) if e != table[i]}


def test_result_does_not_depend_on_partitions_and_is_stable(spark):
    once = sorted(map(str, _emails(spark, 1).table.collect()))
    assert once == sorted(map(str, _emails(spark, 5).table.collect()))
    again = apply_rules(_emails(spark).table.select("_rid", "email"), [contact.email_rules("email")])
    assert sorted((r._rid, str(r.email)) for r in again.table.collect()) == sorted((r._rid, str(r.email)) for r in _emails(spark).table.collect())


def test_saved_result_reads_back_the_same(spark, tmp_path):
    res = _emails(spark)
    kept = res.saved(str(tmp_path / "staged"))
    assert sorted(map(str, kept.table.collect())) == sorted(map(str, res.table.collect()))
    assert sorted(map(str, kept.rule_counts().collect())) == sorted(map(str, res.rule_counts().collect()))


def test_plan_grows_with_steps_not_exponentially(spark):
    df = spark.createDataFrame([(1, "+1 (555) 010-1234", 9)], "_rid int, phone string, owner int")
    res = apply_rules(df, [contact.phone_rules("phone", id_column="owner")])
    plan = res.flags.filter("rule = 'PHONE-06'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2_000_000


def test_names(spark):
    df = spark.createDataFrame([(1, "dr. mary o'neil-mcdonald PhD"), (2, "DOE, john")], "_rid int, n string")
    got = {r._rid: (r.n, r.n_suffix) for r in apply_rules(df, [identity.full_name_rules("n", fuzzy=False)]).table.collect()}
    assert got == {1: ("Mary O'Neil-mcdonald", "Phd"), 2: ("John Doe", None)}


def test_formula_discovery_finds_the_sum(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i), float(i + i * i)) for i in range(1, 30)], "_rid int, a double, b double, t double")
    assert numeric.discover_formula(df, "t", ["a", "b", "t"])["operation"] == "add"


def _likeness(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def test_fuzzy_pairs_match_brute_force(spark):
    import random
    rnd = random.Random(3)
    base = ["maria lopez", "mario lopes", "marta gomez", "martin stone"]
    rows = []
    for i in range(70):
        name = rnd.choice(base)
        if rnd.random() < 0.5:
            at = rnd.randrange(4, len(name))
            name = name[:at] + rnd.choice("abcxyz") + name[at + 1:]
        # one contact belongs to a third of the rows
        rows.append((i, name, None if rnd.random() < 0.2 else f"id{rnd.randrange(12):05d}", "hot@mail.org" if i % 3 == 0 else f"u{rnd.randrange(20)}@mail.org"))
    df = spark.createDataFrame(rows, "_rid int, name string, code string, mail string").repartition(4)
    texts = {r._rid: r.asDict() for r in duplicates.comparison_texts(df, ["name"], ["code"], ["mail"]).collect()}
    heads = {}
    for i in sorted(texts):
        heads.setdefault(tuple(v for k, v in texts[i].items() if k != "_rid"), i)
    ids = sorted(heads.values())
    want = set()
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = texts[ids[x]], texts[ids[y]]
            if a["block"] != b["block"]:
                continue
            total = weight = 0
            for k, ts in (("name", ("name_0", "name_1", "name_2")), ("id", ("id_0",)), ("contact", ("contact_0",))):
                sims = [_likeness(a[t], b[t]) for t in ts if a[t] is not None and b[t] is not None]
                if sims:
                    total += duplicates.FUZZY_WEIGHTS[k] * max(sims)
                    weight += duplicates.FUZZY_WEIGHTS[k]
            if total / weight >= 0.85 - 1e-12:
                want.add((ids[x], ids[y]))
    # rows with equal texts pair with the first of them
    for i in texts:
        head = heads[tuple(v for k, v in texts[i].items() if k != "_rid")]
        if head != i:
            want.add((head, i))
    got = {(r.rid_a, r.rid_b) for r in duplicates.fuzzy_pairs(df, ["name"], ["code"], ["mail"]).collect()}
    assert got == want
