import pytest

from keyloom.functions.rules import check_entries
from keyloom.functions import text as t
from pyspark.sql import functions as F

CASES = [
    ("item.a", "Iron door", "", ["翻译为空"]), ("item.a", "Iron door", "Iron door", ["值相同"]), ("item.a", "IRON_DOOR", "IRON_DOOR", []), ("item.a", "", "", []),
    ("x.music_disc.y.desc", "Some Song", "Some Song", []), ("x.music_disc.y.desc", "Some Song", "某歌", ["唱片名"]),
    ("item.a", "%d of %s", "%s的%d", []), ("item.a", "%d of %s", "%s", ["占位符不一致: 缺失占位符: %d"]), ("item.a", "a", "一%d", ["多余占位符: %d"]),
    ("item.a", "%1$s killed %2$s", "%2$s被%1$s杀", []), ("item.a", "%msg% {0} {a}", "{a}", ["缺失变量: %msg%; 缺失变量: {0}"]), ("item.a", "{0} {0}", "{0}", ["缺失变量: {0}"]),
    ("item.a", "§aHi &b", "§b嗨", ["§颜色码不一致: EN有1个, ZH有1个; &颜色码不一致: EN有1个, ZH有0个"]), ("item.a", "<b>x</b><br>", "<b>叉</b>", ["HTML标签不一致: EN有3个, ZH有2个; <br>数量不一致: EN=1, ZH=0"]),
    ("item.a", "a\\nb", "甲乙", ["换行符数量不一致: EN=1, ZH=0"]), ("item.a", "$(l:a/b)x$(item)", "$(item)叉", ["$(action)占位符不一致: EN有2个, ZH有1个"]),
    ("item.a", "x", "中.文", ["应使用'。'"]), ("item.a", "x", "中: 文，见http://a", []), ("item.a", "x", "中文:", ["应使用'：'"]), ("item.a", "x", "中 ，文", ["中文标点间有不必要空格（1处）"]),
    ("item.a", "x", "中文 abc", ["中英文间有不必要空格（1处）"]), ("book.a", "x", "中文 abc", []), ("item.a", "x", "【中】", ["应使用'[]'"]), ("item.a", "x", "中文　", ["尾部有多余空格"]),
    ("item.a", "10 FE", "10能量FE消耗", []), ("item.a", "10 FE and 5 RF", "10能量", ["缺少: FE, RF"]), ("item.a", "10 FE", "10 FE RF", ["缺少: "]), ("item.a", "FEED", "喂", []),
    ("item.a", "x...", "叉...", ["三个英文句号"]), ("subtitles.a", "Door opens", "门开了", ["声音字幕"]), ("subtitles.a", "Zapping", "电击", []), ("subtitles.a", "Door opens", "门：开", []),
    ("item.a", '{"text": "a", "color": "red"}', '{"text": "甲", "color": "red"}', []), ("item.a", '{"text": "a", "color": "red"}', '{"text": "甲", "color": "blue", "bold": 1}', ["非text键被修改: .color; 多余键: .bold"]),
    ("item.a", '{"text": "a"}', "甲", ["格式已破坏"]), ("item.a", '{"text": broken', '{"text": 坏', []), (None, None, None, []),
]


def test_rules(spark):
    df = spark.createDataFrame([(*c[:3], i, "n") for i, c in enumerate(CASES)], "key string, en string, zh string, pos long, namespace string")
    got = {}
    for r in check_entries(df).orderBy("pos", "seq").collect():
        got.setdefault(r.pos, []).append(r.reason)
    for i, c in enumerate(CASES):
        found = got.get(i, [])
        for want in c[3]:
            assert any(want in r for r in found), (c, found)
        if not c[3]:
            assert not found, (c, found)


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abd", 66.67), ("abc", "abcdef", 50.0), ("", "a", 0.0), ("中文", "中", 50.0), ("same", "same", 100.0)])
def test_similarity(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(t.similarity(F.col("a"), F.col("b"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("<b>Iron</b> §aSword %d of it_x 9a",)], "s string").select(t.tokens(F.col("s")).alias("w"))
    assert df.first().w == ["iron", "sword", "of", "it_x"]
    assert df.select(t.ngrams(F.col("w"), 3).alias("g")).first().g == ["iron sword of", "sword of it_x"]
    keys = spark.createDataFrame([("item.x",), ("trim_y",), ("zzz",), ("ae2guide:a.md",)], "k string").select(t.key_prefix(F.col("k")).alias("p"))
    assert [r.p for r in keys.collect()] == ["item.", "trim", "__default__", "ae2guide:"]
    terms = spark.createDataFrame([("iron",), ("ab",), ("iron2",), ("the iron",), (" Iron Block ",), ("sword",)], "s string").select(t.valid_term(F.col("s")).alias("v"))
    assert [r.v for r in terms.collect()] == [True, False, False, False, False, True]
    v = spark.createDataFrame([("1.10.2", "1.9")], "a string, b string").select((t.version_parts(F.col("a")) > t.version_parts(F.col("b"))).alias("later"))
    assert v.first().later
