from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import batches, cost, dates, jsonx, keys, text


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize("raw, want", [("20260301", "2026-03-01"), ("202603011400", "2026-03-01"), ("2026.03.01", "2026-03-01"), ("2026-03-01T1", "2026-03-01"), (" 2026-13-45 ", "2026-13-45"), ("20261345", "20261345"), ("", ""), (None, ""), ("soon", "soon")])
def test_normalise_date(spark, raw, want):
    assert one(spark, dates.normalise_date(F.col("x")), raw) == want


@pytest.mark.parametrize("raw, want", [("until 2026/3/1!", "2026-03-01"), ("80-1-2", "1980-01-02"), ("79.1.2", "2079-01-02"), ("x20261231x", "2026-12-31"), ("2026년 3월 1일", "2026-03-01"), ("none", None), (None, None)])
def test_find_date(spark, raw, want):
    assert one(spark, dates.find_date(F.col("x")), raw) == want


@pytest.mark.parametrize("end, want", [("2026-03-01", "closed"), ("2026-03-02", "ongoing"), ("", "ongoing"), (None, "ongoing"), ("bad", "ongoing")])
def test_status_closes_on_the_day(spark, end, want):
    assert one(spark, dates.status(F.col("x"), F.lit("2026-03-01 09:00:00")), end) == want


def test_days_back(spark):
    at = F.lit("2026-03-10").cast("date")
    assert [one(spark, dates.days_back(F.col("x"), at), v) for v in ("2026-03-01", "2027-01-01", "", None)] == [10, 1, 1, 1]


def test_html_and_lists(spark):
    assert one(spark, text.breaks_to_lines(F.col("x")), " a&eacute;<br/>b<b>c</b> ") == "aé\nb<b>c</b>"
    assert one(spark, text.html_to_text(F.col("x")), "<p>a &lt;i&gt;x</p><BR>b   c\n\n\n\nd") == "a x\n\nb c\n\nd"
    assert one(spark, text.split_list(F.col("x")), "a, b,,c ") == ["a", "b", "c"]
    assert one(spark, text.last_of_path(F.col("x")), "a > b") == "b"
    assert one(spark, text.last_of_path(F.col("x")), "a") == ""
    assert one(spark, text.norm_key(F.col("x")), "A b·(c)-[D]_e.") == "abcde"


def test_names_and_links(spark):
    assert one(spark, text.name_from_url(F.col("x")), "http://h/a/b%20c.PDF?x=1") == "b c.PDF"
    assert one(spark, text.extension(F.col("x")), "b c.PDF") == "pdf"
    assert one(spark, text.safe_name(F.col("x")), "가 b/c.pdf") == "가_b_c.pdf"
    assert one(spark, text.drop_size_suffix(F.col("x")), "plan.hwp (69KB)") == "plan.hwp"
    assert one(spark, text.first_url(F.col("x")), "see (http://a.b/c).") == "http://a.b/c"
    assert one(spark, text.link_from_script(F.col("x"), r"go\('(\d+)','(\w+)'\)", "/v?id={id}&k={2}", 2), "javascript:go('7','q')") == "/v?id=7&k=q"
    assert one(spark, text.line_of(F.col("x"), F.lit(4)), "ab\ncd\ne") == 1


def test_json_in_text(spark):
    for answer, want in (("x\n```json\n{\"a\": 1}\n```", '{"a": 1}'), ('{"a": 2}', '{"a": 2}'), ('so {"a": 3} ok', '{"a": 3}'), ("nothing", "{}"), ("{broken", "{}")):
        assert one(spark, jsonx.json_in_text(F.col("x")), answer) == want


def test_cost_formula(spark):
    price = lambda i, o, w=0, r=0: one(spark, cost.token_cost(F.lit(3.0), F.lit(15.0), F.lit(i), F.lit(o), cache_write=F.lit(w), cache_read=F.lit(r)))
    assert price(7547, 2153) == 76.9
    assert price(62814, 9892) == pytest.approx(471.6, abs=0.1)
    assert price(49718, 10657, 1620, 11340) == pytest.approx(445.9, abs=0.1)


def test_keys(spark):
    assert one(spark, keys.padded_id("src_", F.col("x"), 4), 12, "int") == "src_0012"
    assert one(spark, keys.composite_key(F.col("x"), F.lit("00"))) is None
    assert one(spark, keys.claim_id(F.lit("s"), F.col("x")), "t").startswith("cl_")


def test_pieces_hold_few_rows_and_bytes():
    """Every row once and in order; objects are made of a piece, never of a whole batch."""
    rows = ["x" * (n % 7) for n in range(1000)] + ["y" * 300_000] * 9 + ["z" * 3_000_000]
    got = list(batches.pieces([pa.record_batch({"t": rows[:5]}), pa.record_batch({"t": rows[5:]}), pa.record_batch({"t": rows[:0]})]))
    assert [t for p in got for t in p.column("t").to_pylist()] == rows
    assert all(p.num_rows == 1 or p.num_rows <= batches.ROWS and p.nbytes <= batches.BYTES for p in got)
