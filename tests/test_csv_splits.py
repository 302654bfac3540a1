import csv
import io
import random

import pytest

from fieldglass.plans import tenure
from fieldglass.sources import csv_splits


def random_csv(seed, n, width=4):
    rng = random.Random(seed)
    pieces = ["a", "é日", '"', '""', ",", "\n", "\r\n", "\n\n", " ", "", "x" * 30, '","', '"\n"']
    rows = [[f"c{i}" for i in range(width)]] + [["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(width if rng.random() > 0.2 else width - 1)] for _ in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,size", [(1, "50b"), (2, "90b"), (3, "200b"), (4, "100m")])
def test_equal_to_a_serial_reader_wherever_splits_end(spark, tmp_path, seed, size):
    text = random_csv(seed, 12)
    (tmp_path / "x.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows, counts = csv_splits.read_csv_splits(spark, str(tmp_path / "x.csv"), 4)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    serial = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r) for r in serial if len(r) >= 4)
    assert [tuple(r)[1:] for r in counts.collect()] == [(len(serial), sum(len(r) < 4 for r in serial))]


def test_short_rows_without_width_and_odd_files(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿a,b,c\r\n1\r\n\r\n"2\n2",,"x"\n3,4,"never closed\nend'.encode())
    rows, _ = csv_splits.read_csv_splits(spark, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", None, None), ("2\n2", "", "x"), ("3", "4", "never closed\nend")], key=str)
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        csv_splits.read_csv_splits(spark, str(tmp_path / "empty.csv"))
    for i in range(3):
        (tmp_path / f"m{i}.csv").write_text(f'h\n"{i}\n{i}"\n{i}\n')
    got = csv_splits.fields(spark, str(tmp_path / "m*.csv")).collect()
    assert sorted(r["values"][0] for r in got) == sorted(["h"] * 3 + [f"{i}\n{i}" for i in range(3)] + ["0", "1", "2"])


def test_short_legacy_rows_of_depth_charts_are_dropped_and_counted(spark, tmp_path):
    names = [f"x{i}" for i in range(26)]
    for i, n in {0: "season", 9: "gsis_id", 13: "depth_position", 15: "dt", 16: "team"}.items():
        names[i] = n
    full = lambda **v: [v.get(n, "") for n in names]
    with open(tmp_path / "d.csv", "w", newline="") as f:
        csv.writer(f).writerows([names, full(season="2020", gsis_id="a", depth_position="L\nWR"), ["2021", "b", "c", "d"], full(dt="2025-01-01", gsis_id="m"), full(gsis_id="neither")])
    raw, counts = tenure.depth_chart_rows(spark, str(tmp_path / "d.csv"))
    legacy, modern = tenure.split_depth_charts(raw)
    assert [(r.season, r.gsis_id, r.depth_position) for r in legacy.collect()] == [("2020", "a", "L WR")] and [r.gsis_id for r in modern.collect()] == ["m"]
    assert [(r.records, r.short) for r in counts.collect()] == [(4, 1)]
