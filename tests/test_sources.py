import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from urnstat.games import G6
from urnstat.operators import frequency as freq
from urnstat.operators import likelihood as L
from urnstat.operators.features import row_features
from urnstat.plans import pipeline
from urnstat.sources import raw, records, store

G5_TEXT = '''Draw Date,Results,Jackpot,Outcome
"Friday
25 April 2025","5
 9
 13
 46
 47
 11"," R25,000,000.00 ",Roll
Tuesday 5 August 2025,10 32 34 40 48 14,"R10,000,000.00",Won
Friday 8 August 2025,1 2 3 4 5,R1,Roll
Tuesday 12 August 2025,1 2 x 4 5 6,R1,Roll
soon,1 2 3 4 5 6,R1,Roll
'''

G6_TEXT = '''Year,Date,Series,Bonus
2025,25 April,"1
2
3
4
5
52",7
2025,26 April,"8,9,10,11,12,13",14
2025,27 April,"1,2,3",4
2025,28 April
2025,29 April,"1,2,3,4,5,6",7,more
'''


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_read_raw_g5(spark, folder):
    (folder / "raw.csv").write_text(G5_TEXT)
    clean = raw.read_raw_g5(spark, str(folder / "raw.csv"))
    assert clean.count() == 4  # five tokens go
    df = raw.with_draw_date(raw.parse_balls(clean)).orderBy("draw_date_raw")
    rows = [(r.draw_date_raw, r.draw_date, r.balls, r.bonus, r.jackpot, r.outcome) for r in df.collect()]
    assert rows == [
        ("Friday 25 April 2025", dt.date(2025, 4, 25), [5, 9, 13, 46, 47], 11, "R25,000,000.00", "Roll"),
        ("Tuesday 5 August 2025", dt.date(2025, 8, 5), [10, 32, 34, 40, 48], 14, "R10,000,000.00", "Won"),
        ("soon", None, [1, 2, 3, 4, 5], 6, "R1", "Roll"),
    ]


def test_read_raw_g6(spark, folder):
    (folder / "raw.csv").write_text(G6_TEXT)
    df = raw.with_day(raw.parse_balls(raw.read_raw_g6(spark, str(folder / "raw.csv")), G6)).orderBy("date")
    rows = [(r.draw_date, r.day, r.balls, r.bonus) for r in df.collect()]
    assert rows == [
        (dt.date(2025, 4, 25), "Friday", [1, 2, 3, 4, 5, 52], 7),
        (dt.date(2025, 4, 26), "Saturday", [8, 9, 10, 11, 12, 13], 14),
    ]


def test_raw_records_become_history(spark, folder):
    (folder / "g5.csv").write_text(G5_TEXT)
    (folder / "g6.csv").write_text(G6_TEXT)
    five = raw.to_draws(raw.parse_balls(raw.read_raw_g5(spark, str(folder / "g5.csv"))), "g5")
    six = raw.to_draws(raw.with_day(raw.parse_balls(raw.read_raw_g6(spark, str(folder / "g6.csv")), G6)), "g6")
    assert five.columns == six.columns == raw.DRAWS.names
    assert sorted(len(r.balls) for r in five.unionByName(six).collect()) == [5, 5, 5, 6, 6]
    again = raw.to_draws(raw.parse_balls(raw.read_raw_g5(spark, str(folder / "g5.csv"))), "g5")
    assert sorted(r.draw_id for r in again.collect()) == sorted(r.draw_id for r in five.collect())
    paths = pipeline.Paths(f"{folder}/tables")
    store.append_draws(paths.history, five)
    pipeline.refresh(spark, paths)
    assert pipeline.load_calculated(spark, paths).count() == 3


def sample(spark):
    rows = [("x", 1, dt.date(2025, 1, 1), [1, 2, 3, 4, 5], 6, "R1", "Roll"), ("1", 2, None, [7, 8, 9, 10, 11], 6, "R2", "Won")]
    return spark.createDataFrame(rows, raw.DRAWS)


def test_clean_table_round_trip(spark, folder):
    store.write_clean(sample(spark), f"{folder}/clean")
    back = store.load_draws(spark, f"{folder}/clean").select(*raw.DRAWS.names)
    assert sorted(back.collect()) == sorted(sample(spark).collect())


def test_csv_has_one_column_per_slot(spark, folder):
    store.write_clean(sample(spark), f"{folder}/clean", fmt="csv")
    back = spark.read.option("header", True).csv(f"{folder}/clean")
    assert back.columns == ["series", "draw_id", "draw_date", "b1", "b2", "b3", "b4", "b5", "bonus", "jackpot", "outcome"]
    schema = "series string, draw_id long, draw_date date, b1 int, b2 int, b3 int, b4 int, b5 int, bonus int, jackpot string, outcome string"
    typed = store.load_draws(spark, f"{folder}/clean", schema, "csv")
    assert sorted(r.b1 for r in typed.collect()) == [1, 7]


def test_calculated_table_round_trip(spark, folder):
    store.write_calculated(row_features(sample(spark)), f"{folder}/calculated")
    back = store.load_draws(spark, f"{folder}/calculated", schema=None).orderBy("draw_id").collect()
    assert [(r["mean"], r["range"], r["has_consecutive"]) for r in back] == [(3.0, 4, True), (9.0, 4, True)]


def test_frequency_files(spark, folder):
    counts = freq.frequency(sample(spark))
    store.write_frequency(counts, f"{folder}/by_number")
    store.write_frequency(counts, f"{folder}/high_low", order="high_low")

    def lines(name):
        (part,) = (folder / name).glob("part-*.csv")
        return part.read_text().splitlines()

    assert lines("by_number")[:3] == ["Number,Frequency", "1,1", "2,1"]
    assert lines("high_low")[:3] == ["Number,Frequency", "6,2", "1,1"]


def test_prediction_of_a_date_is_replaced(spark, folder):
    pred = spark.createDataFrame([([1, 2, 3, 4, 5],)], "balls array<int>")
    table = spark.createDataFrame([(1, 0.5), (2, 1.5)], "number int, likelihood double")
    for day in (26, 27, 27):
        store.write_prediction(pred, table, dt.date(2025, 4, day), str(folder))
    back = spark.read.parquet(f"{folder}/likelihood")
    assert back.groupBy("run_date").count().orderBy("run_date").collect() == [
        (dt.date(2025, 4, 26), 2),
        (dt.date(2025, 4, 27), 2),
    ]
    assert spark.read.parquet(f"{folder}/prediction").count() == 2


def test_appending_a_named_batch_again_replaces_it(spark, folder):
    for _ in range(2):
        store.append_draws(f"{folder}/h", sample(spark), batch="first")
    store.append_draws(f"{folder}/h", sample(spark).withColumn("draw_id", F.col("draw_id") + 10))
    ids = sorted(r.draw_id for r in store.load_history(spark, f"{folder}/h").collect())
    assert ids == [1, 2, 11, 12]


def test_union_takes_columns_by_name(spark):
    new = sample(spark).select(*reversed(raw.DRAWS.names))
    assert store.union_draws(sample(spark), new).count() == 4


def test_likelihood_columns(spark):
    probs = L.empirical_probs(sample(spark))
    assert probs.columns == ["slot", "number", "p"]


def _quoted(rng, text):
    return '"' + text.replace('"', '""') + '"' if rng.random() < 0.8 or set(text) & set('",\n\r') else text


def test_byte_ranges_read_what_one_task_reads(spark, tmp_path, monkeypatch):
    """Borders fall on quotes, inside fields, between lines and on line ends of both kinds."""
    rng = random.Random(7)
    for n in range(2):
        with open(tmp_path / f"{n}.csv", "w", newline="") as out:
            for _ in range(40):
                cells = ["".join(rng.choices(['a', '"', '""', "\n", "\r\n", ",", "é", " "], k=rng.randrange(1, 9))) for _ in range(4)]
                out.write(",".join(_quoted(rng, c) for c in cells) + ["\n", "\r\n"][n])
    # One task writes line ends inside fields as the file's first one tells; ranges leave them alone.
    shown = lambda df: sorted(repr(r).replace("\\r\\n", "\\n") for r in df.collect())
    names = raw.RAW_G6.names
    options = {"multiLine": True, "quote": '"', "escape": '"', "header": True}
    want = shown(spark.read.schema(raw.RAW_G6).options(**options).csv(str(tmp_path)))
    key = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for most in (records.MOST_RANGES, 0):  # parities sent along, or met in a shuffle
            monkeypatch.setattr(records, "MOST_RANGES", most)
            for size in (23, 64, 171, 100_000):
                spark.conf.set(key, str(size))
                got = raw._read(spark, str(tmp_path), raw.RAW_G6, header=True).select(*names)
                assert shown(got) == want
                assert size > 1000 or got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
