"""The deterministic format rules: each is one column, a verdict struct or null; all run in one scan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, FAIL, SUGGEST, Settings
from . import text as t

VERDICT = "struct<key: string, en_current: string, zh_current: string, verdict: string, suggestion: string, reason: string, source: string>"

# Half-width marks between Han characters, with what they should be.
_HAN = "[\u4e00-\u9fff]"
PUNCTUATION = (
    (rf"(?U){_HAN}\s*\.\s*{_HAN}", ".", "。"), (rf"(?U){_HAN}\s*,\s*{_HAN}", ",", "，"), (rf"(?U){_HAN}\s*\?\s*{_HAN}", "?", "？"), (rf"(?U){_HAN}\s*!\s*{_HAN}", "!", "！"),
    (rf"(?U){_HAN}\s*;\s*{_HAN}", ";", "；"), (rf"(?U){_HAN}\s*:", ":", "："), (rf"(?U){_HAN}\s*\(|\)\s*{_HAN}", "()", "（）"), ("[【】]", "【】", "[]"),
)
MARK_SPACE = rf"(?U){_HAN}\s+[，。；：？！、]|[，。；：？！、]\s+{_HAN}"
WORD_SPACE = rf"(?U){_HAN}\s+[A-Za-z0-9]|[A-Za-z0-9]\s+{_HAN}"


def verdict(name: str, reason: Column, source: str = "format_check", suggestion: Column | None = None) -> Column:
    return F.struct(F.col("key").alias("key"), F.col("en").alias("en_current"), F.col("zh").alias("zh_current"), F.lit(name).alias("verdict"), (suggestion if suggestion is not None else F.lit("")).alias("suggestion"), reason.alias("reason"), F.lit(source).alias("source"))


#: What several places of the rules read of each text; found once, in columns of their own.
FOUND = {
    "printf": t.printf_items, "percent": lambda c: t.all_matches(c, t.PERCENT_NAME), "brace": lambda c: t.all_matches(c, t.BRACE_NAME, 1), "color": lambda c: t.all_matches(c, t.COLOR), "alt": lambda c: t.all_matches(c, t.ALT_COLOR),
    "action": lambda c: t.all_matches(c, t.ACTION), "tag": lambda c: t.all_matches(c, t.TAG), "break": lambda c: F.regexp_count(c, F.lit(t.BREAK)), "newline": lambda c: F.regexp_count(c, F.lit(t.NEWLINE)), "unit": lambda c: t.all_matches(c, t.UNIT, 1),
}


def found(name: str) -> tuple[Column, Column]:
    """What FOUND has of the source and of the target text."""
    return F.col(f"_{name}_en"), F.col(f"_{name}_zh")


def _joined(issues: list[Column]) -> Column:
    """The issues that aren't null, joined; null if there are none."""
    found = F.array_compact(F.array(*issues))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def empty_or_same(s: Settings = DEFAULTS) -> Column:
    head = F.substring(F.col("en"), 1, s.preview)
    # the cheap tests first
    open_ = (F.col("en") != "") & ~t.music_disc(F.col("key")) & ~t.code_like(F.col("en"))
    return F.when((F.col("zh") == "") & open_, verdict(FAIL, _text("翻译为空，原文'", head, "'未翻译"))).when((F.col("en") == F.col("zh")) & open_, verdict(FAIL, _text("值相同（'", head, "'），疑似未翻译")))


def disc_translated(s: Settings = DEFAULTS) -> Column:
    return F.when(t.music_disc(F.col("key")) & (F.col("en") != F.col("zh")) & (F.col("en") != "") & (F.col("zh") != ""), verdict(SUGGEST, _text("唱片名不应翻译，建议保留原文（'", F.substring(F.col("en"), 1, s.preview), "'）")))


def _differences(en: Column, zh: Column, name: str, shape=lambda x: x) -> list[Column]:
    missing, extra = t.more_often(en, zh), t.more_often(zh, en)
    listed = lambda x: F.array_join(F.transform(x, shape), ", ")
    return [F.when(F.size(missing) > 0, _text(f"缺失{name}: ", listed(missing))), F.when(F.size(extra) > 0, _text(f"多余{name}: ", listed(extra)))]


def placeholders(s: Settings = DEFAULTS) -> Column:
    issues = [
        *_differences(*found("printf"), "占位符"),
        *_differences(*found("percent"), "变量"),
        *_differences(*found("brace"), "变量", lambda x: F.concat(F.lit("{"), x, F.lit("}"))),
    ]
    why = _joined(issues)
    return F.when(why.isNotNull(), verdict(FAIL, _text("占位符不一致: ", why)))


def special_tags(s: Settings = DEFAULTS) -> Column:
    issues = []
    for kind, name in (("color", "§颜色码"), ("alt", "&颜色码"), ("action", "$(action)占位符"), ("tag", "HTML标签")):
        en, zh = found(kind)
        issues.append(F.when(~t.same_items(en, zh), _text(f"{name}不一致: EN有", F.size(en), "个, ZH有", F.size(zh), "个")))
    for kind, name in (("break", "<br>数量"), ("newline", "换行符数量")):
        en, zh = found(kind)
        issues.append(F.when(en != zh, _text(f"{name}不一致: EN=", en, ", ZH=", zh)))
    why = _joined(issues)
    return F.when(why.isNotNull(), verdict(FAIL, _text("格式标签不一致: ", why)))


def _json_differences(a, b, path: str = "") -> list[str]:
    """Keys other than text that one JSON value has changed, lost or gained."""
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return []
    out = []
    for k, v in a.items():
        if k == "text":
            continue
        at = f"{path}.{k}"
        if k not in b:
            out.append(f"缺少键: {at}")
            continue
        if v != b[k]:
            out.append(f"非text键被修改: {at}")
        out += _json_differences(v, b[k], at)
    return out + [f"多余键: {path}.{k}" for k in b if k != "text" and k not in a]


def tellraw_differences(en: pd.Series, zh: pd.Series) -> pd.Series:
    """The first three differences of two JSON texts, joined; null if there are none or one can't be parsed."""

    def one(a, b):
        try:
            found = _json_differences(json.loads(a), json.loads(b))
        except (TypeError, ValueError):
            return None
        return "; ".join(found[:3]) or None

    return pd.Series([one(a, b) for a, b in zip(en, zh, strict=True)], dtype=object)


def tellraw(differences: Column, s: Settings = DEFAULTS) -> Column:
    broken = verdict(FAIL, F.lit("EN为tellraw JSON但ZH格式已破坏"))
    return F.when(t.strip(F.col("en")).rlike(t.TELLRAW), F.when(~t.strip(F.col("zh")).rlike(t.TELLRAW), broken).when(differences.isNotNull(), verdict(FAIL, _text("tellraw JSON非text键被修改: ", differences))))


def punctuation(s: Settings = DEFAULTS) -> Column:
    issues = []
    for pattern, half, full in PUNCTUATION:
        hit = F.col("zh").rlike(pattern) & (~F.col("zh").contains("http") if half == ":" else F.lit(True))
        issues.append(F.when(hit, F.lit(f"中文环境中使用了{half}，应使用'{full}'")))
    n, m = F.regexp_count(F.col("zh"), F.lit(MARK_SPACE)), F.regexp_count(F.col("zh"), F.lit(WORD_SPACE))
    free = t.any_of([F.col("key").startswith(p) for p in s.spacing_whitelist])
    issues += [F.when(n > 0, _text("中文与中文标点间有不必要空格（", n, "处）")), F.when((m > 0) & ~free, _text("中英文间有不必要空格（", m, "处）"))]
    why = _joined(issues)
    return F.when(t.has_han(F.col("zh")) & why.isNotNull(), verdict(SUGGEST, _text("标点规范: ", why)))


def trailing_space(s: Settings = DEFAULTS) -> Column:
    return F.when((F.col("zh") != t.right_strip(F.col("zh"))) & t.has_han(F.col("zh")), verdict(SUGGEST, F.lit("中文译文尾部有多余空格")))


def energy_units(s: Settings = DEFAULTS) -> Column:
    en, zh = found("unit")
    missing = F.array_join(F.filter(en, lambda u: ~F.array_contains(zh, u)), ", ")
    return F.when((F.size(en) > 0) & ~t.same_items(en, zh), verdict(FAIL, _text("能量/体积单位不应翻译，缺少: ", missing)))


def ellipsis(s: Settings = DEFAULTS) -> Column:
    return F.when(F.col("zh").contains("..."), verdict(SUGGEST, F.lit("使用了三个英文句号'...'作为省略号，应使用'……'（中文省略号）")))


def subtitle(s: Settings = DEFAULTS) -> Column:
    sound = F.col("key").startswith("subtitles.") | F.col("key").startswith("sound.")
    two = t.strip(F.col("en")).rlike(r"(?U)\S\s+\S")
    return F.when(sound & ~F.col("zh").contains("：") & ~F.col("zh").contains(":") & two & (F.length(F.col("en")) < 80), verdict(SUGGEST, F.lit("声音字幕建议使用'主体：声音'格式（全角冒号）")))


#: In the order in which an entry's verdicts come. More can be added: each is a function of the settings.
RULES = {
    "empty_or_same": empty_or_same, "disc_translated": disc_translated, "placeholders": placeholders, "special_tags": special_tags, "punctuation": punctuation,
    "trailing_space": trailing_space, "energy_units": energy_units, "ellipsis": ellipsis, "subtitle": subtitle,
}
#: Where the JSON rule stands among them; it needs a Python step and is left out if no text can be JSON.
TELLRAW_AT = 4


def check_entries(entries: DataFrame, settings: Settings = DEFAULTS, rules: dict | None = None, with_tellraw: bool = True) -> DataFrame:
    """A row for each verdict: those of VERDICT, seq (the rule's place) and the entry's pos if it has one.

    Null texts count as empty.
    """
    rows = entries.withColumns({"en": F.coalesce(F.col("en"), F.lit("")), "zh": F.coalesce(F.col("zh"), F.lit(""))})
    rows = rows.withColumns({f"_{name}_{c}": f(F.col(c)) for name, f in FOUND.items() for c in ("en", "zh")})
    checks = [f(settings) for f in (rules or RULES).values()]
    if with_tellraw and rules is None:
        may = t.strip(F.col("en")).rlike(t.TELLRAW) & t.strip(F.col("zh")).rlike(t.TELLRAW)
        rows = rows.withColumn("tellraw_differences", F.when(may, F.pandas_udf(tellraw_differences, "string")(F.when(may, F.col("en")), F.when(may, F.col("zh")))))
        checks.insert(TELLRAW_AT, tellraw(F.col("tellraw_differences"), settings))
    keep = [c for c in ("pos", "namespace") if c in entries.columns]
    return rows.select(*keep, F.posexplode(F.array(*checks)).alias("seq", "v")).where("v is not null").select(*keep, "seq", "v.*")
