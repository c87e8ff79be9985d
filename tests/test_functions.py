import math

from pyspark.sql import functions as F

from pageflow.functions import arrays, geometry, numbers, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_code_points(spark):
    got = [one(spark, text.code_point_char(F.col("s")), s=s) for s in ("U+3042", "U+2000B", "U+24E30", "U+ZZZZ", "U+", "a", "U+D800")]
    assert got == ["あ", "\U0002000b", "\U00024e30", "U+ZZZZ", "U+", "a", "U+D800"]


def test_white_space_and_invisible_differ(spark):
    s = "a　b﻿c​d\x1ce\x7ff\n"
    assert one(spark, text.strip_white_space(F.col("s")), s=s) == "ab﻿c​de\x7ff"
    assert one(spark, text.strip_invisible(F.col("s")), s=s) == "abcdef"


def test_characters_are_code_points(spark):
    assert one(spark, text.characters(F.col("s")), s="a\U0002000bb") == ["a", "\U0002000b", "b"]
    assert one(spark, text.characters(F.col("s")), s="") == []
    assert one(spark, text.spaced(F.col("s")), s="abc") == "a b c"


def test_reverse(spark):
    assert one(spark, text.reversed_text(F.col("s")), s="ab cd") == "cd ab"
    assert one(spark, text.reversed_text(F.col("s")), s="a\U0002000b") == "\U0002000ba"


def test_names(spark):
    assert one(spark, text.stem(F.col("s")), s="/a/b/page.01.png") == "page.01"
    assert one(spark, text.extension(F.col("s")), s="/a/b/page.01.PNG") == ".png"
    assert one(spark, text.stem(F.col("s")), s=".hidden") == ".hidden"
    seq, side = text.page_numbers(F.col("s"))
    assert one(spark, F.struct(seq.alias("a"), side.alias("b")), s="100_00012_2").asDict() == {"a": 12, "b": 2}
    assert one(spark, seq, s="100_x_2") is None
    assert one(spark, text.count_of(F.col("s"), "aa"), s="aaaaa") == 2
    assert one(spark, text.wrapped(F.col("s"), 3), s="abcdefg") == "abc\ndef\ng"
    assert one(spark, text.human_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.normalise_line(F.col("s")), s=" a　b\r\n") == "a b"


def test_natural_key_orders_numbers(spark):
    names = ["p10.png", "p2.png", "p1.png", "P3.png"]
    df = spark.createDataFrame([(n,) for n in names], ["n"]).orderBy(text.natural_key(F.col("n")))
    assert [r["n"] for r in df.collect()] == ["p1.png", "p2.png", "P3.png", "p10.png"]


def test_clamp_rounds_half_to_even(spark):
    for x, want in ((0.5, 0), (1.5, 2), (2.5, 2)):
        c = geometry.clamp_box(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(10.0), F.lit(100), F.lit(100))
        assert one(spark, c["x1"], x=x) == want
    c = geometry.clamp_box(F.col("x"), F.lit(5.0), F.lit(-20.0), F.lit(0.0), F.lit(100), F.lit(100))
    assert one(spark, F.struct(*[v.alias(k) for k, v in c.items()]), x=50.0).asDict() == {"x1": 50, "y1": 5, "x2": 51, "y2": 6}


def test_iou(spark):
    def value(a, b):
        df = spark.createDataFrame([(*a, *b)], "x1 int, y1 int, x2 int, y2 int, u1 int, v1 int, u2 int, v2 int")
        return df.select(geometry.iou(geometry.box(), {"x1": F.col("u1"), "y1": F.col("v1"), "x2": F.col("u2"), "y2": F.col("v2")}).alias("v")).first()["v"]

    assert value((0, 0, 10, 10), (0, 0, 10, 10)) == 1.0
    assert value((0, 0, 10, 10), (0, 0, 10, 5)) == 0.5
    assert value((0, 0, 10, 10), (20, 20, 30, 30)) == 0.0
    assert value((0, 0, 0, 0), (0, 0, 0, 0)) == 0.0


def test_tile_starts_equal_the_loop(spark):
    for size in (1, 639, 640, 641, 960, 961, 1280, 3001):
        want, y = [], 0
        while True:
            want.append(y)
            if y + 640 >= size:
                break
            y += 320
        assert one(spark, geometry.tile_starts(F.col("s"), 640, 320), s=size) == want


def test_polygons(spark):
    c = geometry.polygon_box(F.array(*[F.lit(v) for v in (-3, 5, 10, 5, 10, 9, -3, 9)]))
    assert one(spark, F.struct(*[v.alias(k) for k, v in c.items()])).asDict() == {"x1": 0, "y1": 5, "x2": 10, "y2": 9}


def test_letterbox(spark):
    w, h, left, top = geometry.letterbox(F.lit(100), F.lit(50), 64)
    assert tuple(one(spark, F.array(w, h, left, top))) == (64, 32, 0, 16)


def test_numbers(spark):
    assert one(spark, numbers.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    got = one(spark, numbers.log_softmax(F.array(F.lit(1.0), F.lit(2.0))))
    assert math.isclose(sum(math.exp(x) for x in got), 1.0)
    assert one(spark, numbers.quantise(F.lit(45.0), 5.0, 45.0, 16)) == 15
    assert math.isclose(one(spark, numbers.cubic(F.lit(0.0))), 1.0) and one(spark, numbers.cubic(F.lit(2.5))) == 0.0
    assert math.isclose(one(spark, numbers.multistep_rate(F.lit(25), 1.0, [10, 20])), 0.01)


def test_array_helpers(spark):
    top = F.array(*[F.struct(F.lit(c).alias("char"), F.lit(p).alias("logp")) for c, p in (("a", -2.0), ("b", -1.0), ("a", -0.5))])
    assert [tuple(r) for r in one(spark, arrays.best_by_char(top))] == [("a", -0.5), ("b", -1.0)]
    scores = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(i).alias("class_id")) for i, s in enumerate((0.1, 0.9, 0.9))])
    assert [r["class_id"] for r in one(spark, arrays.top_k(scores, 2))] == [1, 2]
    assert one(spark, arrays.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit(10)), lambda a, b: a + b)) == [11]


def test_invalid_bytes_go_and_own_marks_stay(spark):
    df = spark.createDataFrame([(bytearray("a\ufffdb".encode() + b"\xff" + "\ufdd0\ufdd1c".encode()),)], "b binary")
    got = df.select(text.decoded(F.col("b"), "ignore").alias("i"), text.decoded(F.col("b")).alias("r")).first()
    assert got["i"] == "a\ufffdb\ufdd0\ufdd1c" and got["r"] == "a\ufffdb\ufffd\ufdd0\ufdd1c"


def test_schedules_step_by_step(spark):
    """Against schedulers that go step by step from the rate before."""
    steps = spark.range(600)
    milestones, restarts, weights = [100, 200, 250, 250], [200, 400], [0.5, 0.25]
    got = [r[0] for r in steps.orderBy("id").select(numbers.multistep_restart_rate(F.col("id"), 0.01, milestones, 0.1, restarts, weights)).collect()]
    rate = 0.01
    for i, g in enumerate(got):
        rate = 0.01 * weights[restarts.index(i)] if i in restarts else rate * 0.1 ** milestones.count(i)
        assert abs(g - rate) < 1e-15
    some = [r[0] for r in spark.createDataFrame([(s,) for s in (0, 10, 400, 1200)], "s int").select(numbers.vibrate_rate(F.col("s"), 1.0, 1600)).collect()]
    assert [round(x, 3) for x in some] == [0.1, 0.983, 0.0, 0.0]


def test_code_points_of_any_length(spark):
    got = [one(spark, text.code_point_char_anywhere(F.col("s")), s=s) for s in ("U+3042", "U+9", "U+30U+42", "U+", "a", "U+ZZ")]
    assert got == ["あ", "\t", "あ", "U+", "a", "U+ZZ"]


def test_options_as_text():
    from pageflow.sources import readers

    assert readers.options_text({"a": 1, "b": {"c": "x"}}) == "\n  a: 1\n  b:[\n    c: x\n  ]\n"
