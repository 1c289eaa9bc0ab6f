"""The queries of the review engine's operators over the driver's tables, and the SQL that their results are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as a
from .config import DEFAULTS, FOCUS, KEY_PREFIXES, KEYBOARD_GUIDANCE, MOUSE_GUIDANCE, OTHER_FOCUS, STOP_WORDS
from .functions import rules
from .functions import text as t
from .operators import align, fuzzy, glossary, history, lemma, lexicon, recall, review, routing, terms, verdicts
from .operators.answers import AnswerLog
from .operators.recall_index import RecallIndex
from .operators.tables import cut, scratch_path
from .plans.review_plan import run_filter, run_review
from .sources import files, sinks
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---- alignment
_CODE = r"(regexp_matches({0}, '^[A-Z_]+$') OR regexp_matches({0}, '^[0-9]+$') OR regexp_matches({0}, '^[A-Za-z0-9_.-]+$') OR regexp_matches({0}, '^§[0-9a-fA-F].*') OR regexp_matches({0}, '^%[a-zA-Z0-9_.$]*$') OR regexp_matches({0}, '^\{{[^{{}}]*\}}$') OR regexp_matches({0}, '^%[A-Za-z_]\w*%$'))"
_strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_code = lambda c: _CODE.format(_strip(c))
_ALIGNED = f"""WITH s AS (SELECT {a.SOURCE_MAP[0]} AS key, {a.SOURCE_MAP[1]} AS en FROM documents), t AS (SELECT {a.TARGET_MAP[0]} AS key, {a.TARGET_MAP[1]} AS zh FROM documents),
 aligned AS (SELECT coalesce(s.key, t.key) AS key, en, zh, CASE WHEN s.key IS NOT NULL AND t.key IS NOT NULL THEN 'matched' WHEN t.key IS NULL THEN 'missing_zh' ELSE 'extra_zh' END AS status FROM s FULL JOIN t ON s.key = t.key) """
_SUSPICIOUS = f"(status = 'matched' AND en = zh AND NOT {_code('en')})"


def _aligned(spark, d):
    return align.align(a.language_map(spark, d, a.SOURCE_MAP), a.language_map(spark, d, a.TARGET_MAP))


@query(_ALIGNED + "SELECT key, en, zh FROM aligned WHERE status = 'matched'")
def align_matched(spark, d):
    return align.matched(_aligned(spark, d))


@query(_ALIGNED + "SELECT key, en FROM aligned WHERE status = 'missing_zh'")
def align_missing(spark, d):
    return align.missing(_aligned(spark, d))


@query(_ALIGNED + "SELECT key, zh FROM aligned WHERE status = 'extra_zh'")
def align_extra(spark, d):
    return align.extra(_aligned(spark, d))


@query(_ALIGNED + f"SELECT key, en, zh, '值相同，疑似未翻译' AS reason FROM aligned WHERE {_SUSPICIOUS}")
def align_suspicious(spark, d):
    return align.suspicious(_aligned(spark, d))


_count = lambda c, name: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {name}"


@query(_ALIGNED + "SELECT " + ", ".join([_count("status = 'matched'", "matched"), _count("status = 'missing_zh'", "missing_zh"), _count("status = 'extra_zh'", "extra_zh"), _count(_SUSPICIOUS, "suspicious_untranslated"), _count("status <> 'extra_zh'", "total_en"), _count("status <> 'missing_zh'", "total_zh")]) + " FROM aligned")
def align_stats(spark, d):
    return align.align_stats(_aligned(spark, d))


@query("SELECT CAST(d.doc_id AS STRING) AS key, substring(text, 1, 120) AS mod_value, CAST(quality AS STRING) AS vanilla_zh, '1.0' AS version_start, concat('1.', CAST(toxic AS STRING)) AS version_end, quality AS changes FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def collision_lookup(spark, d):
    vanilla = a.table(spark, d, "labels").selectExpr("CAST(doc_id AS STRING) AS key", "CAST(quality AS STRING) AS zh_cn", "'1.0' AS version_start", "concat('1.', CAST(toxic AS STRING)) AS version_end", "quality AS changes", "doc_id AS pos")
    # of two rows for a key the later counts
    older = vanilla.withColumns({"zh_cn": F.lit("older"), "pos": F.lit(-1).cast("long")})
    return align.collisions(a.language_map(spark, d, a.SOURCE_MAP), vanilla.unionByName(older))


_SIDES = ", ".join(f"{n} AS (SELECT {k} AS key, {v} AS v FROM documents)" for n, (k, v) in a.REVISIONS.items())
_DIFF = f"""WITH {_SIDES}, keys AS (SELECT key FROM old_en UNION SELECT key FROM new_en UNION SELECT key FROM old_zh UNION SELECT key FROM new_zh),
 wide AS (SELECT k.key, coalesce(oe.v, '') AS old_en, coalesce(ne.v, '') AS new_en, coalesce(oz.v, '') AS old_zh, coalesce(nz.v, '') AS new_zh FROM keys k LEFT JOIN old_en oe USING (key) LEFT JOIN new_en ne USING (key) LEFT JOIN old_zh oz USING (key) LEFT JOIN new_zh nz USING (key)),
 changes AS (SELECT key, new_en AS en, new_zh AS zh, CASE WHEN old_en <> new_en THEN old_en END AS old_en, CASE WHEN old_zh <> new_zh THEN old_zh END AS old_zh,
  CASE WHEN old_en <> new_en AND old_zh <> new_zh THEN 'normal' WHEN old_en <> new_en THEN 'en_changed_zh_unchanged' ELSE 'zh_only_change' END AS review_type,
  CASE WHEN old_en <> new_en AND old_zh = new_zh AND old_en <> '' THEN '原文变更（EN）但翻译（ZH）未跟随变更' END AS warning FROM wide WHERE old_en <> new_en OR old_zh <> new_zh) """
_GONE = "(en = '' AND zh = '' AND (coalesce(old_en, '') <> '' OR coalesce(old_zh, '') <> ''))"


def _changes(spark, d):
    return align.diff_revisions(*[a.language_map(spark, d, a.REVISIONS[n]) for n in ("old_en", "new_en", "old_zh", "new_zh")])


@query(_DIFF + "SELECT * FROM changes")
def diff4_classify(spark, d):
    return _changes(spark, d)


@query(_DIFF + "SELECT key, warning FROM changes WHERE warning IS NOT NULL")
def diff4_warnings(spark, d):
    return _changes(spark, d).where("warning is not null").select("key", "warning")


@query(_DIFF + f"SELECT key, old_en, old_zh FROM changes WHERE {_GONE}")
def diff4_deletions(spark, d):
    return _changes(spark, d).where(align.is_deletion()).select("key", "old_en", "old_zh")


@query(_DIFF + f"SELECT right(key, 1) AS namespace, {_count(f'NOT {_GONE}', 'entries')}, " + ", ".join(_count(f"NOT {_GONE} AND review_type = '{k}'", k) for k in ("normal", "en_changed_zh_unchanged", "zh_only_change")) + f", {_count('warning IS NOT NULL', 'warnings')}, {_count(_GONE, 'deletions')} FROM changes GROUP BY 1")
def change_stats(spark, d):
    return align.change_stats(_changes(spark, d).withColumn("namespace", F.right("key", F.lit(1))))


@query(_DIFF + "SELECT key, right(key, 2) AS namespace, review_type FROM changes WHERE right(key, 2) IN (SELECT right(key, 2) FROM changes WHERE warning IS NOT NULL)")
def warned_namespaces(spark, d):
    return align.warned_entries(_changes(spark, d).withColumn("namespace", F.right("key", F.lit(2)))).select("key", "namespace", "review_type")


_HOST = "regexp_extract(url, '^https?://([^/.]+)', 1)"
_FILE = f"""concat('projects/', CASE WHEN page_id % 2 = 0 THEN concat('assets/', {_HOST}, '/1.', CAST(page_id % 3 AS STRING)) ELSE concat('1.', CAST(page_id % 3 AS STRING), '/assets/', {_HOST}) END, '/s', CAST(page_id % 50 AS STRING), CASE WHEN page_id % 13 = 0 THEN '/other/' ELSE '/lang/' END, CASE WHEN page_id % 4 < 3 THEN 'en_us' ELSE 'zh_cn' END, '.json')"""
_STATUS = "CASE page_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END"
_GUIDE = f"concat('projects/assets/', {_HOST}, '/1.', CAST(page_id % 3 AS STRING), '/s/ae2guide/', CASE WHEN page_id % 2 = 0 THEN '_zh_cn/' ELSE '' END, 'p', CAST(page_id % 100 AS STRING), CASE WHEN page_id % 9 = 0 THEN '.txt' ELSE '.md' END)"
_PATH = r"^projects/(?:assets/([^/]+)/([^/]+)|([^/]+)/assets/([^/]+))/([^/]+)/lang/(en_us|zh_cn)\.json$"
_g = lambda i, p=_PATH: f"regexp_extract(filename, '{p}', {i})"


def _slots(old: str) -> str:
    return ", ".join(f"max(CASE WHEN lang = '{lang}' AND {has} THEN filename END) AS {n}" for lang, has, n in (("en_us", old, "en_base"), ("en_us", "status <> 'removed'", "en_head"), ("zh_cn", old, "zh_base"), ("zh_cn", "status <> 'removed'", "zh_head")))


@query(f"""WITH f AS (SELECT {_FILE} AS filename, {_STATUS} AS status FROM pages), p AS (SELECT *, CASE WHEN {_g(1)} <> '' THEN {_g(1)} ELSE {_g(4)} END AS project, CASE WHEN {_g(2)} <> '' THEN {_g(2)} ELSE {_g(3)} END AS version, {_g(5)} AS slug, {_g(6)} AS lang FROM f WHERE regexp_matches(filename, '{_PATH}')),
 w AS (SELECT concat(version, '/', project, '/', slug) AS module, version, project, slug, {_slots("status NOT IN ('added', 'renamed')")} FROM p GROUP BY ALL)
 SELECT module, version, project, slug, en_base, en_head, CASE WHEN zh_head IS NULL AND en_head IS NOT NULL THEN replace(en_head, '/en_us.json', '/zh_cn.json') ELSE zh_base END AS zh_base, CASE WHEN zh_head IS NULL AND en_head IS NOT NULL THEN replace(en_head, '/en_us.json', '/zh_cn.json') ELSE zh_head END AS zh_head FROM w""")
def slot_pairing(spark, d):
    return align.pair_slots(a.table(spark, d, "pages").selectExpr(f"{_FILE} AS filename", f"{_STATUS} AS status"))


_GPATH = r"^projects/(?:assets/([^/]+)/([^/]+)|([^/]+)/assets/([^/]+))/([^/]+)/ae2guide/(?:(_zh_cn)/)?(.+\.md)$"


@query(f"""WITH f AS (SELECT {_GUIDE} AS filename, {_STATUS} AS status FROM pages), p AS (SELECT *, {_g(1, _GPATH)} AS project, {_g(2, _GPATH)} AS version, {_g(5, _GPATH)} AS slug, CASE WHEN {_g(6, _GPATH)} <> '' THEN 'zh_cn' ELSE 'en_us' END AS lang, {_g(7, _GPATH)} AS rel_path FROM f WHERE regexp_matches(filename, '{_GPATH}'))
 SELECT version, project, slug, rel_path, {_slots("status NOT IN ('added', 'renamed')")}, concat('ae2guide:', rel_path) AS key FROM p GROUP BY version, project, slug, rel_path""")
def guide_pairing(spark, d):
    return align.pair_guides(a.table(spark, d, "pages").selectExpr(f"{_GUIDE} AS filename", f"{_STATUS} AS status"))


# ---- predicates and scalar functions
@query(f"SELECT event_id, {_code('event_type')} AS type_code, {_code('props')} AS props_code FROM events")
def code_like_filter(spark, d):
    return a.table(spark, d, "events").select("event_id", t.code_like(F.col("event_type")).alias("type_code"), t.code_like(F.col("props")).alias("props_code"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_TOKENS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '§[0-9a-fA-Fk-oK-OrR]', ' ', 'g'), '%[+-]?\d*\.?\d*[dsf]', ' ', 'g')), '[a-zA-Z][a-zA-Z0-9_]+')"


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) SELECT w, (length({_strip('lower(w)')}) > 2 AND NOT regexp_matches(w, '[0-9]') AND lower({_strip('w')}) NOT IN {_STOPS} AND len([x FOR x IN regexp_split_to_array({_strip('lower(w)')}, '\\s+') IF x IN {_STOPS}]) = 0) AS valid FROM w")
def term_validity(spark, d):
    words = a.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return words.select("w", t.valid_term(F.col("w")).alias("valid"))


@query(f"SELECT page_id, {_TOKENS.format('html')} AS tokens FROM pages")
def tokenize(spark, d):
    return a.table(spark, d, "pages").select("page_id", t.tokens(F.col("html")).alias("tokens"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part), b AS (SELECT DISTINCT p_type FROM part) SELECT p_name, p_type, round_even(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type))), 2) AS sim FROM n, b")
def edit_similarity(spark, d):
    part = a.table(spark, d, "part")
    types = part.agg(F.array_sort(F.collect_set("p_type")).alias("types"))  # a handful of names
    names = part.select("p_name").distinct().join(types, F.lit(True)).select("p_name", F.explode("types").alias("p_type"))
    return names.select("p_name", "p_type", t.similarity(F.col("p_name"), F.lower("p_type")).alias("sim"))


_PREFIX = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN '{p}'" for p in sorted(KEY_PREFIXES, key=len, reverse=True)) + " ELSE '__default__' END"
_LABEL = "CASE prefix " + " ".join(f"WHEN '{p}' THEN '{x}'" for p, (x, _) in KEY_PREFIXES.items()) + " ELSE '其他' END"


@query(f"WITH {a.ENTRIES_SQL} SELECT key, prefix, {_LABEL} AS label FROM (SELECT key, {_PREFIX} AS prefix FROM entries)")
def prefix_classify(spark, d):
    p = t.key_prefix(F.col("key"))
    return a.entries(spark, d).select("key", p.alias("prefix"), t.prefix_label(p).alias("label"))


@query(f"WITH {a.ENTRIES_SQL} SELECT {_PREFIX} AS prefix, bool_or(regexp_matches(en, '(?i)\\b(Shift|Ctrl|Alt|Tab)\\b')) AS keyboard, bool_or(regexp_matches(concat(en, zh), '(?i)\\b(?:left\\s*click|right\\s*click|left[- ]?mouse|right[- ]?mouse|mouse\\s*button|scroll\\s*wheel|drag|double[-\\s]?click|middle\\s*click|mouse\\s*over|hover)\\b|(?:左键|右键|鼠标|单击|双击|点击|拖拽|滚轮)')) AS mouse FROM entries GROUP BY 1")
def input_guidance(spark, d):
    return routing.input_guidance(a.entries(spark, d).withColumn("prefix", t.key_prefix(F.col("key"))), ["prefix"])


# ---- rules
_DISC = "(contains(key, 'music_disc') AND ends_with(key, '.desc'))"
_HAN = "[一-鿿㐀-䶿]"
_C = "[一-鿿]"
_all = lambda c, p, g=0: f"regexp_extract_all({c}, '{p}', {g})"
_printf = lambda c: f"""list_concat({_all(c, r'%[+-]?\d*\.?\d*[dsf]')}, list_transform({_all(c, r'%\d+\$[dsf]')}, lambda p: concat('%', right(p, 1))))"""


def _more(x: str, y: str) -> str:
    """Distinct items, in order of first occurrence, that are more often in x than in y."""
    return f"[u FOR u, i IN {x} IF list_position({x}, u) = i AND len(list_filter({x}, lambda q: q = u)) > len(list_filter({y}, lambda q: q = u))]"


def _diff_sql(en: str, zh: str, name: str, shape: str = "{0}") -> list[str]:
    out = []
    for x, y, word in ((en, zh, "缺失"), (zh, en, "多余")):
        m = f"list_filter(list_transform({x}, lambda u, i: CASE WHEN list_position({x}, u) = i AND len(list_filter({x}, lambda q: q = u)) > len(list_filter({y}, lambda q: q = u)) THEN u END), lambda u: u IS NOT NULL)"
        shown = m if shape == "{0}" else f"list_transform({m}, lambda u: concat('{{', u, '}}'))"
        out.append(f"CASE WHEN len({m}) > 0 THEN concat('{word}{name}: ', array_to_string({shown}, ', ')) END")
    return out


_issues = lambda parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"
_sorted_ne = lambda p, g=0: f"list_sort({_all('en', p, g)}) <> list_sort({_all('zh', p, g)})"
_COLOR, _ALT, _ACT, _TAG = "§[0-9a-fA-Fk-oK-OrR]", "&[0-9a-fA-F]", r"\$\((?:l:[^)]*|[a-zA-Z_]\w*)\)", r"</?[a-zA-Z_]\w*(?:\s[^>]*)?/?>"
_TAG_ISSUES = [f"CASE WHEN {_sorted_ne(p)} THEN concat('{n}不一致: EN有', len({_all('en', p)}), '个, ZH有', len({_all('zh', p)}), '个') END" for p, n in ((_COLOR, "§颜色码"), (_ALT, "&颜色码"), (_ACT, "$(action)占位符"), (_TAG, "HTML标签"))]
_TAG_ISSUES += [f"CASE WHEN len({_all('en', p)}) <> len({_all('zh', p)}) THEN concat('{n}不一致: EN=', len({_all('en', p)}), ', ZH=', len({_all('zh', p)})) END" for p, n in ((r"(?i)<br\s*/?>", "<br>数量"), (r"\\n|\n", "换行符数量"))]
_MARKS = [(rf"{_C}\s*\.\s*{_C}", ".", "。"), (rf"{_C}\s*,\s*{_C}", ",", "，"), (rf"{_C}\s*\?\s*{_C}", "?", "？"), (rf"{_C}\s*!\s*{_C}", "!", "！"), (rf"{_C}\s*;\s*{_C}", ";", "；"), (rf"{_C}\s*:", ":", "："), (rf"{_C}\s*\(|\)\s*{_C}", "()", "（）"), ("[【】]", "【】", "[]")]
_PUNCT = [f"CASE WHEN regexp_matches(zh, '{p}'){' AND NOT contains(zh, ' + chr(39) + 'http' + chr(39) + ')' if h == ':' else ''} THEN '中文环境中使用了{h}，应使用''{f}''' END" for p, h, f in _MARKS]
_MS, _WS = _all("zh", rf"{_C}\s+[，。；：？！、]|[，。；：？！、]\s+{_C}"), _all("zh", rf"{_C}\s+[A-Za-z0-9]|[A-Za-z0-9]\s+{_C}")
_PUNCT += [f"CASE WHEN len({_MS}) > 0 THEN concat('中文与中文标点间有不必要空格（', len({_MS}), '处）') END", f"CASE WHEN len({_WS}) > 0 AND NOT (starts_with(key, 'book.') OR starts_with(key, 'patchouli.')) THEN concat('中英文间有不必要空格（', len({_WS}), '处）') END"]
# RE2 has no look-around: the characters before and after are taken along, and neighbours that share one are kept apart by doubling separators
_UNITS = lambda c: f"regexp_extract_all({c}, '\\b(FE|RF|MB|EU|AE|kJ|kW|kRF)\\b', 1)"
_head = lambda c: f"substring({c}, 1, 60)"
_F, _S = "❌ FAIL", "⚠️ SUGGEST"
_PH = [*_diff_sql(_printf("en"), _printf("zh"), "占位符"), *_diff_sql(_all("en", "%[A-Za-z_]\\w*%"), _all("zh", "%[A-Za-z_]\\w*%"), "变量"), *_diff_sql(_all("en", r"\{(\d+|[a-zA-Z_]\w*)\}", 1), _all("zh", r"\{(\d+|[a-zA-Z_]\w*)\}", 1), "变量", "brace")]
#: By rule: verdict, reason (null or empty where it doesn't apply), in the order of the rules.
_RULE_SQL = {
    "empty_or_same": (_F, f"CASE WHEN en <> '' AND NOT {_DISC} AND NOT {_code('en')} AND zh = '' THEN concat('翻译为空，原文''', {_head('en')}, '''未翻译') WHEN en <> '' AND NOT {_DISC} AND NOT {_code('en')} AND en = zh THEN concat('值相同（''', {_head('en')}, '''），疑似未翻译') END"),
    "disc_translated": (_S, f"CASE WHEN {_DISC} AND en <> zh AND en <> '' AND zh <> '' THEN concat('唱片名不应翻译，建议保留原文（''', {_head('en')}, '''）') END"),
    "placeholders": (_F, f"CASE WHEN {_issues(_PH)} <> '' THEN concat('占位符不一致: ', {_issues(_PH)}) END"),
    "special_tags": (_F, f"CASE WHEN {_issues(_TAG_ISSUES)} <> '' THEN concat('格式标签不一致: ', {_issues(_TAG_ISSUES)}) END"),
    "punctuation": (_S, f"CASE WHEN regexp_matches(zh, '{_HAN}') AND {_issues(_PUNCT)} <> '' THEN concat('标点规范: ', {_issues(_PUNCT)}) END"),
    "trailing_space": (_S, rf"CASE WHEN regexp_matches(zh, '\s$') AND regexp_matches(zh, '{_HAN}') THEN '中文译文尾部有多余空格' END"),
    "energy_units": (_F, f"CASE WHEN len({_UNITS('en')}) > 0 AND list_sort({_UNITS('en')}) <> list_sort({_UNITS('zh')}) THEN concat('能量/体积单位不应翻译，缺少: ', array_to_string(list_filter({_UNITS('en')}, lambda u: NOT list_contains({_UNITS('zh')}, u)), ', ')) END"),
    "ellipsis": (_S, "CASE WHEN contains(zh, '...') THEN '使用了三个英文句号''...''作为省略号，应使用''……''（中文省略号）' END"),
    "subtitle": (_S, r"CASE WHEN (starts_with(key, 'subtitles.') OR starts_with(key, 'sound.')) AND NOT contains(zh, '：') AND NOT contains(zh, ':') AND regexp_matches(en, '\S\s+\S') AND length(en) < 80 THEN '声音字幕建议使用''主体：声音''格式（全角冒号）' END"),
}


def _rule_sql(names) -> str:
    return " UNION ALL ".join(f"SELECT key, en AS en_current, zh AS zh_current, '{_RULE_SQL[n][0]}' AS verdict, '' AS suggestion, reason, 'format_check' AS source, pos, namespace, {i} AS seq FROM (SELECT *, {_RULE_SQL[n][1]} AS reason FROM entries) WHERE reason IS NOT NULL" for i, n in enumerate(names))


_ALL_RULES = f"WITH {a.ENTRIES_SQL}, found AS ({_rule_sql(_RULE_SQL)})"


def _rule(name: str) -> None:
    def one(spark, d):
        return rules.check_entries(a.entries(spark, d), rules={name: rules.RULES[name]}).select("key", "verdict", "reason")

    one.__name__ = f"rule_{name}"
    query(f"WITH {a.ENTRIES_SQL} SELECT key, verdict, reason FROM ({_rule_sql([name])})")(one)


for _name in rules.RULES:
    _rule(_name)


@query(_ALL_RULES + " SELECT key, en_current, zh_current, verdict, suggestion, reason, source FROM found")
def rules_all(spark, d):
    return rules.check_entries(a.entries(spark, d)).select(*verdicts.COLUMNS)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'EN为tellraw JSON但ZH格式已破坏' WHEN event_id % 3 = 1 THEN 'tellraw JSON非text键被修改: 非text键被修改: .v' END AS reason FROM events WHERE event_id % 3 < 2")
def rule_tellraw(spark, d):
    en = F.concat(F.lit('{"text": "a", "v": '), "props", F.lit("}"))
    zh = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"text": "b", "v": 0}')).otherwise(F.concat(F.lit('{"text": "c", "v": '), "props", F.lit("}")))
    rows = a.table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), en.alias("en"), zh.alias("zh"))
    found = rules.check_entries(rows).where(F.contains("reason", F.lit("tellraw")))
    return found.select(F.col("key").cast("long").alias("event_id"), "reason")


# ---- terms
def _grams(n: int) -> str:
    return f"list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"


_DOCS = f"WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)"


def _terms_sql(kind: str, min_freq: int, items: str, more: str = "") -> str:
    return f"""{_DOCS}, o AS (SELECT doc_id, unnest({items}) AS term FROM d {more}), f AS (SELECT term, count(*) AS freq FROM o GROUP BY 1 HAVING count(*) >= {min_freq})
 SELECT term, CAST(freq AS BIGINT) AS freq, (SELECT list(CAST(doc_id AS STRING) ORDER BY doc_id) FROM (SELECT doc_id FROM o WHERE o.term = f.term ORDER BY doc_id LIMIT 5)) AS keys FROM f"""


def _ranked_sql(min_freq: int, items: str) -> str:
    return f"""{_DOCS}, o AS (SELECT doc_id, unnest({items}) AS term FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY term) AS freq FROM o)
 SELECT term, CAST(any_value(freq) AS BIGINT) AS freq, list(CAST(doc_id AS STRING) ORDER BY doc_id) FILTER (WHERE nth <= 5) AS keys FROM r WHERE freq >= {min_freq} GROUP BY term"""


def _doc_terms(spark, d, kind, min_freq):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.col("doc_id").alias("pos"))
    return terms.extract_terms(docs, kind, min_freq)


@query(_ranked_sql(2, f"list_filter(list_distinct(w), lambda x: x NOT IN {_STOPS})"))
def ngram_unigrams(spark, d):
    return _doc_terms(spark, d, "unigrams", 2)


@query(f"{_DOCS}, f AS (SELECT term, CAST(count(*) AS BIGINT) AS freq FROM (SELECT doc_id, unnest(list_filter(list_distinct(w), lambda x: x NOT IN {_STOPS})) AS term FROM d) GROUP BY 1 HAVING count(*) >= 2) SELECT CAST(row_number() OVER (ORDER BY freq DESC, term) AS BIGINT) AS rank, term, freq FROM f")
def terms_in_order(spark, d):
    """The terms of all documents by frequency, then by name, with their place."""
    return terms.in_order(_doc_terms(spark, d, "unigrams", 2)).select("rank", "term", "freq")


@query(_ranked_sql(3, _grams(2)))
def ngram_bigrams(spark, d):
    return _doc_terms(spark, d, "bigrams", 3)


@query(_ranked_sql(3, f"list_concat({_grams(3)}, CASE WHEN len(w) > 3 THEN [array_to_string(w, ' ')] ELSE [] END)"))
def ngram_trigrams(spark, d):
    return _doc_terms(spark, d, "trigrams", 3)


@query(_ranked_sql(2, "CASE WHEN len(w) >= 2 THEN [array_to_string(w, ' ')] ELSE [] END"))
def full_phrases(spark, d):
    return _doc_terms(spark, d, "full", 2)


#: Terms of part: each word of a name, in the case that the row's brand says, with its first keys.
_WORD = "CASE WHEN pos % 3 = 0 THEN upper(w) ELSE w END"
_OCC = f"{a.PARTS_SQL}, o AS (SELECT key, pos, {_WORD} AS term, en, zh FROM (SELECT *, unnest(string_split(en, ' ')) AS w FROM parts))"
_TERMS = f"{_OCC}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pos) AS nth, count(*) OVER (PARTITION BY term) AS freq FROM o), terms AS (SELECT term, any_value(freq) AS freq, list(key ORDER BY pos) FILTER (WHERE nth <= 20) AS keys FROM r GROUP BY term)"
_BUCKETS = f"{_TERMS}, b0 AS (SELECT lower(term) AS norm, min(term) AS normalized, list_sort(list(term)) AS variants, CAST(sum(freq) AS BIGINT) AS freq, flatten(list(keys ORDER BY term)) AS ks FROM terms GROUP BY 1), buckets AS (SELECT norm, normalized, variants, freq, list_transform(list_sort(list_transform(list_distinct(ks), lambda k: {{'i': list_position(ks, k), 'k': k}})), lambda x: x.k)[1:20] AS keys FROM b0)"


def _part_occurrences(spark, d):
    words = a.parts(spark, d).select("key", "pos", "en", "zh", F.explode(F.split("en", " ")).alias("w"))
    return words.withColumn("term", F.when(F.col("pos") % 3 == 0, F.upper("w")).otherwise(F.col("w")))


def _buckets(spark, d):
    from pyspark.sql import Window

    o = _part_occurrences(spark, d)
    freq = o.groupBy("term").agg(F.count("*").alias("freq"))
    few = o.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("pos"))).where("nth <= 20").groupBy("term").agg(terms.first_keys("pos", "key", 20).alias("keys"))
    return terms.bucket_terms(freq.join(few, "term").withColumns({"ngram_type": F.lit("unigrams"), "ord": F.col("term")}))


@query(f"WITH {_BUCKETS} SELECT norm, normalized, variants, freq, keys FROM buckets")
def bucket_merge(spark, d):
    return _buckets(spark, d).select("norm", "normalized", "variants", "freq", "keys")


_REDIRECT = "CASE norm WHEN 'bolt' THEN 'gear' WHEN 'ring' THEN 'small ring' WHEN 'red' THEN 'blue' ELSE norm END"


@query(f"""WITH {_BUCKETS}, m AS (SELECT *, CASE norm WHEN 'bolt' THEN 'gear' WHEN 'red' THEN 'blue' ELSE norm END AS target FROM buckets), g AS (SELECT target AS norm, list_sort(list_distinct(flatten(list(variants)))) AS variants, flatten(list(keys ORDER BY normalized)) AS ks FROM m GROUP BY 1)
 SELECT norm, variants, list_transform(list_sort(list_transform(list_distinct(ks), lambda k: {{'i': list_position(ks, k), 'k': k}})), lambda x: x.k)[1:20] AS keys, CAST(len(list_distinct(ks)[1:20]) AS BIGINT) AS freq FROM g""")
def redirect_merge(spark, d):
    redirect = spark.createDataFrame([("bolt", "gear"), ("ring", "small ring"), ("red", "blue")], "norm string, target string")
    return terms.merge_buckets(_buckets(spark, d), redirect).select("norm", "variants", "keys", "freq")


@query(f"WITH {_BUCKETS} SELECT norm, CASE norm WHEN 'bolt' THEN 'fastener' ELSE 'color' END AS target FROM buckets WHERE norm IN ('bolt', 'red', 'blue')")
def cache_redirects(spark, d):
    cache = spark.createDataFrame([("color", ["red", "blue"], 3), ("fastener", ["bolt", "red"], 1), ("small gear", ["gear"], 1)], "canonical string, variants array<string>, freq long")
    return terms.cache_redirects(_buckets(spark, d), cache)


# ---- consensus
_CAND = "cand AS (SELECT DISTINCT lower(term) AS norm, key, pos, zh FROM o WHERE zh <> '' AND zh <> en AND length(zh) <= 40 AND length(en) <= 60), hist AS (SELECT norm, zh, CAST(count(*) AS BIGINT) AS cnt, min(pos) AS first FROM cand GROUP BY 1, 2)"
_HIST = f"WITH {_OCC}, {_CAND}"


def _keyed_buckets(spark, d):
    """Buckets without keys, and all their keys (norm, key) as rows, so that every row of the table counts and no term gathers its own."""
    o = _part_occurrences(spark, d).withColumn("norm", F.lower("term"))
    return o.groupBy("norm").agg(F.array_sort(F.collect_set("term")).alias("variants")), o.select("norm", "key").distinct()


def _all_buckets(spark, d):
    """Buckets that hold all their keys, for the rescue, which takes them from each other."""
    o = _part_occurrences(spark, d)
    return o.groupBy(F.lower("term").alias("norm")).agg(F.array_sort(F.collect_set("term")).alias("variants"), F.array_sort(F.collect_set("key")).alias("keys"))


def _hist(spark, d):
    buckets, keys = _keyed_buckets(spark, d)
    return glossary.histogram(glossary.candidate_translations(buckets, a.parts(spark, d), keys=keys))


@query(f"{_HIST} SELECT norm, zh, cnt, first FROM hist")
def translation_histogram(spark, d):
    return _hist(spark, d)


_MODE = "mode AS (SELECT norm, zh, cnt / total AS share, total, cnt / total >= 0.6 AS agreed FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY norm) AS BIGINT) AS total, row_number() OVER (PARTITION BY norm ORDER BY cnt DESC, first, zh) AS nth FROM hist) WHERE nth = 1 AND total >= 3)"
_COMMON = "common AS (SELECT norm, zh FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(zh) DESC, first, zh) AS nth FROM (SELECT h.norm, h.zh, any_value(h.first) AS first, sum(g.cnt) AS support, any_value(t.total) AS total FROM hist h JOIN hist g ON h.norm = g.norm AND g.zh <> h.zh AND contains(g.zh, h.zh) JOIN (SELECT norm, sum(cnt) AS total FROM hist GROUP BY 1) t ON t.norm = h.norm WHERE length(h.zh) >= 2 GROUP BY 1, 2) WHERE support / total >= {0}) WHERE nth = 1)"


@query(f"{_HIST}, {_MODE} SELECT norm, zh, share, total, agreed FROM mode")
def consensus_mode(spark, d):
    return glossary.mode_translation(_hist(spark, d))


@query(f"{_HIST}, {_COMMON.format('0.01')} SELECT norm, zh FROM common")
def consensus_substring(spark, d):
    return glossary.common_substring(_hist(spark, d), 0.01)


_LOOSE = replace(DEFAULTS, min_consensus=0.05)
_GLOSSARY = f"{_HIST}, {_MODE.replace('>= 0.6', '>= 0.05')}, {_COMMON.format('0.05')}, en AS (SELECT lower(term) AS norm, min(term) AS en, count(DISTINCT key) AS n FROM o GROUP BY 1), glossary AS (SELECT norm, en, zh FROM (SELECT mode.norm, en.en, CASE WHEN agreed THEN mode.zh ELSE common.zh END AS zh FROM mode JOIN en USING (norm) LEFT JOIN common USING (norm) WHERE n >= 5 AND length(norm) > 2 AND norm NOT IN {_STOPS}) WHERE zh IS NOT NULL)"


@query(f"{_GLOSSARY} SELECT norm, en, zh FROM glossary")
def glossary_build(spark, d):
    buckets, keys = _keyed_buckets(spark, d)
    return glossary.build_glossary(buckets, a.parts(spark, d), _LOOSE, keys)


_NAMES = "g AS (SELECT DISTINCT en, zh FROM (SELECT p_name AS en, p_type AS zh FROM part UNION ALL SELECT split_part(p_name, ' ', 1), p_type FROM part))"


def _names(spark, d):
    part = a.table(spark, d, "part")
    return part.selectExpr("p_name AS en", "p_type AS zh").unionByName(part.selectExpr("split_part(p_name, ' ', 1) AS en", "p_type AS zh")).distinct()


@query(f"WITH {_NAMES} SELECT s.en AS short_en, l.en AS long_en, s.zh FROM g s JOIN g l ON s.zh = l.zh AND s.en <> l.en AND length(l.en) >= length(s.en) AND contains(lower(l.en), lower(s.en))")
def zh_conflicts(spark, d):
    return glossary.conflicts(_names(spark, d))


_AGAIN = _MODE.replace(">= 0.6", ">= 0.05").replace("mode AS", "mode2 AS").replace("FROM hist)", "FROM hist2)")


@query(f"""{_GLOSSARY}, pairs AS (SELECT s.norm, s.zh, l.norm AS long FROM glossary s JOIN glossary l ON s.zh = l.zh AND s.norm <> l.norm AND length(l.en) >= length(s.en) AND contains(lower(l.en), lower(s.en))), keyed AS (SELECT DISTINCT lower(term) AS norm, key FROM o),
 rest AS (SELECT norm, key FROM keyed WHERE norm IN (SELECT norm FROM pairs) EXCEPT SELECT p.norm, k.key FROM pairs p JOIN keyed k ON k.norm = p.long), hist2 AS (SELECT norm, zh, CAST(count(*) AS BIGINT) AS cnt, min(pos) AS first FROM rest JOIN cand USING (norm, key) GROUP BY 1, 2), {_AGAIN},
 rescued AS (SELECT m.norm, m.zh AS new_zh FROM mode2 m JOIN glossary g USING (norm) WHERE m.agreed AND m.zh <> g.zh) SELECT norm, en, coalesce(new_zh, zh) AS zh FROM glossary LEFT JOIN rescued USING (norm) WHERE norm NOT IN (SELECT norm FROM pairs) OR new_zh IS NOT NULL""")
def conflict_rescue(spark, d):
    b = _all_buckets(spark, d)
    return glossary.resolve_conflicts(glossary.build_glossary(b, a.parts(spark, d), _LOOSE), b, a.parts(spark, d), _LOOSE)


@query(f"WITH {a.PARTS_SQL}, g AS (SELECT DISTINCT unnest(string_split(en, ' ')) AS term FROM parts) SELECT key, en AS en_current, zh AS zh_current, '❌ FAIL' AS verdict, concat(term, '料') AS suggestion, concat('术语不一致——“', term, '”在术语表中译为“', term, '料', '”，此处未使用') AS reason, 'terminology_check' AS source FROM parts JOIN g ON regexp_matches(en, concat('(?i)\\b(?:', term, ')\\b')) WHERE NOT contains(zh, concat(term, '料'))")
def term_consistency(spark, d):
    parts = a.parts(spark, d)
    words = parts.select(F.explode(F.split("en", " ")).alias("term")).distinct()
    return glossary.check_consistency(parts.select("key", "en", "zh"), words.select("term", F.array("term").alias("variants"), F.concat("term", F.lit("料")).alias("std_zh")))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS term FROM documents), h AS (SELECT term, t.tid, min(t.doc_id) AS pos, any_value(t.n) AS n FROM w JOIN (SELECT doc_id, length(text) AS n, rank() OVER (ORDER BY text) AS tid FROM documents) t USING (doc_id) GROUP BY 1, 2),
 r AS (SELECT *, count(*) OVER (PARTITION BY term) AS every, row_number() OVER (PARTITION BY term ORDER BY n, pos, tid) AS up, row_number() OVER (PARTITION BY term ORDER BY n DESC, pos DESC, tid DESC) AS down FROM h)
 SELECT term, nth, md5(text) AS digest FROM (SELECT term, pos, 0 AS nth FROM r WHERE every >= 2 AND down = 1 UNION ALL SELECT term, pos, CAST(up AS INTEGER) FROM r WHERE every >= 2 AND up <= 4) p JOIN documents d ON d.doc_id = p.pos""")
def context_pick(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return glossary.pick_contexts_of(docs, F.array_distinct(F.split("text", " "))).select("term", F.col("nth").cast("int").alias("nth"), F.md5("text").alias("digest"))


# ---- similarity
_SIMS = "n AS (SELECT p_name AS term, CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS id FROM (SELECT DISTINCT p_name FROM part)), pairs AS (SELECT x.id AS a, y.id AS b, x.term AS term_a, y.term AS term_b, round_even(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(x.term, y.term)::DOUBLE / greatest(length(x.term), length(y.term))), 2) AS sim FROM n x JOIN n y ON x.id < y.id)"


def _name_terms(spark, d):
    from pyspark.sql import Window

    # a small dimension: the distinct names
    return a.table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().withColumn("id", F.row_number().over(Window.orderBy("term")).cast("long"))


@query(f"WITH {_SIMS} SELECT * FROM pairs WHERE sim >= 65")
def sim_pairs(spark, d):
    return terms.similar_pairs(_name_terms(spark, d))


@query(f"WITH RECURSIVE {_SIMS}, e AS (SELECT a, b FROM pairs WHERE sim >= 65 UNION SELECT b, a FROM pairs WHERE sim >= 65), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT m.term AS norm, c.term AS cluster FROM (SELECT node, min(seen) AS root FROM r GROUP BY 1) x JOIN n m ON m.id = x.node JOIN n c ON c.id = x.root")
def term_clusters(spark, d):
    return terms.clusters_of(_name_terms(spark, d))


_MEMORY = "mem AS (SELECT CAST(min(p_partkey) AS STRING) AS key, p_name AS en, min(p_type) AS zh FROM part GROUP BY p_name), q AS (SELECT DISTINCT concat('q', key) AS q_key, concat(split_part(en, ' ', 2), ' ', split_part(en, ' ', 1)) AS query FROM mem)"
_HITS = "toks AS (SELECT key, en, zh, lower(unnest(regexp_extract_all(concat(key, ' ', en, ' ', zh), '[A-Za-z0-9]+'))) AS token FROM mem), cand AS (SELECT DISTINCT q_key, query, key, en, zh FROM (SELECT q_key, query, unnest(string_split(lower(query), ' ')) AS prefix FROM q) JOIN toks ON length(prefix) >= 2 AND starts_with(token, prefix))"


def _memory(spark, d):
    mem = a.table(spark, d, "part").groupBy(F.col("p_name").alias("en")).agg(F.min("p_partkey").cast("string").alias("key"), F.min("p_type").alias("zh"))
    return mem.select("key", "en", "zh"), mem.selectExpr("concat('q', key) AS q_key", "concat(split_part(en, ' ', 2), ' ', split_part(en, ' ', 1)) AS query")


@query(f"WITH {_MEMORY}, {_HITS}, s AS (SELECT *, round_even(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(query, en)::DOUBLE / greatest(length(query), length(en))), 2) AS similarity FROM cand) SELECT q_key, CAST(nth AS INTEGER) AS nth, similarity, key, en, zh FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY similarity DESC, key) AS nth FROM s WHERE similarity >= 20) WHERE nth <= 5")
def fuzzy_topk(spark, d):
    mem, q = _memory(spark, d)
    return fuzzy.fuzzy_search(q, mem, replace(DEFAULTS, fuzzy_threshold=20.0), limit_recall=False)


@query(f"WITH {_MEMORY}, {_HITS} SELECT q_key, key FROM cand")
def fuzzy_recall(spark, d):
    mem, q = _memory(spark, d)
    return fuzzy.recall(q, mem).select("q_key", "key")


#: Lines of which each has one word in common, and the memory after a change of a part of them.
_LINES = "SELECT CAST(p_partkey AS STRING) AS key, concat('part ', p_name, ' ', p_brand) AS en, p_type AS zh FROM part"
_LATER = "SELECT key, CASE WHEN CAST(key AS BIGINT) % 10 = 0 THEN concat('changed ', en) ELSE en END AS en, zh FROM lines WHERE CAST(key AS BIGINT) % 10 <> 3 UNION ALL SELECT concat('new', key), concat('fresh ', en), zh FROM lines WHERE CAST(key AS BIGINT) % 10 = 7"
_CUT = "words AS (SELECT key, lower(unnest(regexp_extract_all(concat(key, ' ', en, ' ', zh), '[A-Za-z0-9]+'))) AS token FROM {0})"


def _lines(spark, d):
    return a.table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS key", "concat('part ', p_name, ' ', p_brand) AS en", "p_type AS zh")


@query(f"""WITH lines AS ({_LINES}), {_CUT.format("lines")}, tf AS (SELECT key, token, count(*) AS tf FROM words GROUP BY 1, 2), size AS (SELECT key, count(*) AS d FROM words GROUP BY 1), every AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
 pre AS (SELECT DISTINCT q_key, unnest(string_split(concat('part ', q_key), ' ')) AS prefix FROM (SELECT DISTINCT p_name AS q_key FROM part)), il AS (SELECT prefix, key, sum(tf) AS tf FROM (SELECT DISTINCT prefix FROM pre) JOIN tf ON starts_with(token, prefix) GROUP BY 1, 2), df AS (SELECT prefix, count(*) AS df FROM il GROUP BY 1),
 wt AS (SELECT prefix, key, CAST(round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / mean)) * 1000000) AS BIGINT) AS w FROM il JOIN df USING (prefix) JOIN size USING (key), every),
 sc AS (SELECT q_key, key, CAST(sum(w) AS BIGINT) AS score, count(*) AS hits FROM pre JOIN wt USING (prefix) GROUP BY 1, 2) SELECT q_key, nth, key, score, hits FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_key ORDER BY score DESC, key) AS INTEGER) AS nth FROM sc) WHERE nth <= 50""")
def recall_best(spark, d):
    """The 50 most relevant lines of each query, of whose words all lines have one."""
    lines = _lines(spark, d)
    q = a.table(spark, d, "part").select(F.col("p_name").alias("q_key")).distinct().withColumn("query", F.concat(F.lit("part "), "q_key"))
    return fuzzy.recall_best(q, lines, 50).select("q_key", F.col("nth").cast("int").alias("nth"), "key", F.round(F.col("score") * 1_000_000).cast("long").alias("score"), "hits")


def _kept_index(spark, d):
    lines = _lines(spark, d)
    n = F.col("key").try_cast("long") % 10  # try: the planner asks it of new keys too
    changed = lines.where(n != 3).withColumn("en", F.when(n == 0, F.concat(F.lit("changed "), "en")).otherwise(F.col("en")))
    fresh = lines.where(n == 7).select(F.concat(F.lit("new"), "key").alias("key"), F.concat(F.lit("fresh "), "en").alias("en"), "zh")
    return RecallIndex.build(lines, scratch_path(spark)).update(changed.unionByName(fresh))


@query(f"WITH lines AS ({_LINES}), later AS ({_LATER}), {_CUT.format('later')} SELECT token, CAST(count(DISTINCT key) AS BIGINT) AS lines, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS rank FROM words GROUP BY token")
def recall_index_dictionary(spark, d):
    """The numbered words of an index that was built and then updated by changed, new and removed lines."""
    return _kept_index(spark, d).dictionary().select("token", "lines", "rank")


@query(f"WITH lines AS ({_LINES}), later AS ({_LATER}), {_CUT.format('later')}, pre AS (SELECT DISTINCT substring(token, 1, 3) AS prefix FROM words WHERE length(token) >= 2) SELECT prefix, key, CAST(count(*) AS BIGINT) AS tf FROM pre JOIN words ON starts_with(token, prefix) GROUP BY 1, 2")
def recall_index_lookup(spark, d):
    """How often each line of the updated index has words with each beginning."""
    index = _kept_index(spark, d)
    prefixes = index.dictionary().where(F.length("token") >= 2).select(F.substring("token", 1, 3).alias("prefix")).distinct()
    return recall.inverted(index.matching(prefixes), index.postings()).select("prefix", "key", F.col("tf").cast("long").alias("tf"))


# ---- dictionary
_DICT = "dict AS (SELECT split_part(p_name, ' ', 1) AS origin_name, p_type AS trans_name, p_brand AS modid FROM part), words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT 'tint'), lemma AS (SELECT 'bolt' AS variant, 'red' AS canonical UNION ALL SELECT 'tint', 'blue')"


@query(f"""WITH {_DICT}, direct AS (SELECT DISTINCT word, trans_name AS zh, modid FROM words JOIN dict ON lower(word) = lower(origin_name)), found AS (SELECT * FROM direct UNION SELECT word, trans_name, modid FROM words JOIN lemma ON word = variant JOIN dict ON lower(origin_name) = canonical WHERE word NOT IN (SELECT lower(origin_name) FROM dict)),
 n AS (SELECT word, zh, CAST(count(DISTINCT modid) AS BIGINT) AS n_mods, list_sort(list(DISTINCT modid)) AS ids FROM found GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n_mods DESC, zh) AS nth FROM n)
 SELECT word, CAST(nth AS INTEGER) AS nth, zh, n_mods, concat(array_to_string(ids[1:5], ', '), CASE WHEN n_mods > 5 THEN concat(' +', CAST(n_mods - 5 AS STRING)) ELSE '' END) AS mods FROM r WHERE nth <= 3""")
def dict_lookup(spark, d):
    part = a.table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(spark.createDataFrame([("tint",)], "word string"))
    lemmas = spark.createDataFrame([("bolt", "red"), ("tint", "blue")], "variant string, canonical string")
    return lexicon.lookup(words, part.selectExpr("split_part(p_name, ' ', 1) AS origin_name", "p_type AS trans_name", "p_brand AS modid"), lemmas)


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT lower(split_part(p_name, ' ', 1))) AS BIGINT) AS n_words FROM part")
def dict_totals(spark, d):
    return lexicon.totals(a.table(spark, d, "part").selectExpr("split_part(p_name, ' ', 1) AS origin_name"))


# ---- routing
_NEED = [p for p, (_, need) in KEY_PREFIXES.items() if need]
_REQUIRED = f"({_PREFIX} IN (" + ", ".join(f"'{p}'" for p in _NEED) + ") OR " + " OR ".join(f"contains(key, '{x}')" for x in (*DEFAULTS.description_parts, ".title")) + " OR length(en) > 80)"


@query(f"WITH {a.ENTRIES_SQL}, found AS ({_rule_sql(_RULE_SQL)}) SELECT key, CASE WHEN key IN (SELECT key FROM found) THEN 'flagged' WHEN {_REQUIRED} THEN 'required' ELSE 'pass' END AS route FROM entries")
def route_split(spark, d):
    e = a.entries(spark, d)
    return routing.route(e.select("key", "en", "zh"), rules.check_entries(e), None).select("key", "route")


@query(f"WITH {a.PARTS_SQL}, g AS (SELECT DISTINCT unnest(string_split(en, ' ')) AS w FROM parts), e AS (SELECT key, concat(en, '!') AS en, CASE WHEN pos % 2 = 0 THEN concat(split_part(en, ' ', 1), '料', split_part(en, ' ', 2), '料') ELSE zh END AS zh FROM parts) SELECT key, CASE WHEN zh = concat(split_part(rtrim(en, '!'), ' ', 1), '料', split_part(rtrim(en, '!'), ' ', 2), '料') THEN 'pass' ELSE 'uncovered' END AS route FROM e")
def glossary_covered(spark, d):
    parts = a.parts(spark, d)
    words = parts.select(F.explode(F.split("en", " ")).alias("en")).distinct().withColumn("zh", F.concat("en", F.lit("料")))
    first, second = F.expr("split_part(en, ' ', 1)"), F.expr("split_part(en, ' ', 2)")
    e = parts.select("key", F.concat("en", F.lit("!")).alias("en"), F.when(F.col("pos") % 2 == 0, F.concat(first, F.lit("料"), second, F.lit("料"))).otherwise(F.col("zh")).alias("zh"))
    return routing.route(e, spark.createDataFrame([], "key string"), words).select("key", "route")


@query(f"WITH {a.ENTRIES_SQL}, found AS ({_rule_sql(_RULE_SQL)}), r AS (SELECT key, CASE WHEN key IN (SELECT key FROM found) THEN 'flagged' WHEN {_REQUIRED} THEN 'required' ELSE 'pass' END AS route FROM entries) SELECT key, CASE WHEN key IN (SELECT key FROM found WHERE contains(reason, '值相同')) THEN 'untranslated' ELSE 'review' END AS queue FROM r WHERE route <> 'pass'")
def untranslated_split(spark, d):
    e = a.entries(spark, d)
    found = cut(rules.check_entries(e).select("key", "reason"))  # read twice, so the rules run once
    return routing.split_untranslated(routing.route(e.select("key", "en", "zh"), found, None), found).select("key", "queue")


@query("WITH c AS (SELECT concat('conv.', CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS key, concat('conv.', CAST(conv_id AS STRING)) AS base, turn, coalesce(text, '') AS en, coalesce(role, '') AS zh FROM conversations) SELECT key, full_en, full_zh FROM c JOIN (SELECT base, string_agg(en, '' ORDER BY turn) AS full_en, string_agg(zh, '' ORDER BY turn) AS full_zh FROM c GROUP BY base HAVING count(*) >= 2) USING (base)")
def multipart_concat(spark, d):
    c = a.table(spark, d, "conversations").selectExpr("concat('conv.', CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS key", "text AS en", "role AS zh")
    return routing.multipart(c)


@query("SELECT conv_id, turn, role, CAST((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 25 AS BIGINT) AS batch FROM conversations")
def batch_number(spark, d):
    return routing.batch_numbers(a.table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", [F.col("conv_id"), F.col("turn")], 25)


@query("SELECT id, concat('[{\"key\": \"', CAST(any_value(n) AS STRING), '\"}]') AS answer FROM (SELECT sha256(text) AS id, length(text) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY id")
def answers_once(spark, d):
    """Answers to prompts of which some were asked before, some repeat, and all are read twice."""
    prompts = a.table(spark, d, "conversations").select(F.col("text").alias("prompt"), "turn")
    log, stub = AnswerLog(spark, scratch_path(spark)), lambda p: '[{"key": "' + str(len(p)) + '"}]'
    log.ask(prompts.where("turn % 2 = 0"), stub)
    return log.ask(prompts.unionByName(prompts), stub).select("id", "answer")


@query(f"WITH {a.PARTS_SQL}, g AS (SELECT DISTINCT unnest(string_split(en, ' ')) AS term FROM parts), h AS (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY term) AS nth FROM parts JOIN g ON contains(lower(en), lower(term))) SELECT key, string_agg(concat('\"', term, '\" → \"', term, '料\"'), ', ' ORDER BY nth) AS hints FROM h WHERE nth <= 5 GROUP BY key")
def glossary_hints(spark, d):
    parts = a.parts(spark, d)
    words = parts.select(F.explode(F.split("en", " ")).alias("en")).distinct().withColumn("zh", F.concat("en", F.lit("料")))
    return routing.glossary_hints(parts.select("key", "en"), words)


@query(f"""WITH {a.PARTS_SQL}, b AS (SELECT key, concat('key: `', key, '`', chr(10), 'EN: "', en, '"', chr(10), 'ZH: "', zh, '"') AS block, (row_number() OVER (ORDER BY key) - 1) // 25 AS batch FROM parts)
 SELECT 'item.' AS prefix, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, md5(concat('物品 ', CAST(count(*) AS STRING), chr(10), chr(10), string_agg(block, concat(chr(10), chr(10)) ORDER BY key))) AS digest FROM b GROUP BY batch""")
def review_prompts(spark, d):
    blocks = routing.entry_blocks(a.parts(spark, d).select("key", "en", "zh"))
    made = routing.prompts(blocks, F.concat("label", F.lit(" "), F.col("n").cast("string")))
    return made.select("prefix", "batch", "n", F.md5("prompt").alias("digest"))


# ---- verdicts
_PRI = "CASE verdict WHEN '❌ FAIL' THEN 3 WHEN '🔶 REVIEW' THEN 2 WHEN '⚠️ SUGGEST' THEN 1 ELSE 0 END"
_MERGED = f"""{_ALL_RULES}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_PRI} DESC, pos, seq) AS nth FROM found), why AS (SELECT key, string_agg(reason, '; ' ORDER BY seq) AS reason FROM found GROUP BY key),
 merged AS (SELECT b.key, b.en_current, b.zh_current, b.verdict, b.suggestion, w.reason, b.source FROM best b JOIN why w USING (key) WHERE nth = 1) """


def _found(spark, d):
    return verdicts.union_verdicts(rules.check_entries(a.entries(spark, d)))


def _merged(spark, d):
    return verdicts.merge_verdicts(_found(spark, d))


def _merged_once(spark, d):
    """For queries that read the verdicts several times: the rules run once."""
    return cut(_merged(spark, d))


@query(_MERGED + "SELECT * FROM merged")
def verdict_merge(spark, d):
    return _merged(spark, d)


@query(_ALL_RULES + " SELECT key, en_current, zh_current, verdict, suggestion, reason, source FROM found")
def verdict_keep_all(spark, d):
    found = cut(rules.check_entries(a.entries(spark, d)))  # read twice, so the rules run once
    return verdicts.keep_all(verdicts.union_verdicts(found, found))


@query(_MERGED + f"SELECT n AS total, n - fail - suggest - review AS passed, fail, suggest, review FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM entries), (SELECT {_count(chr(39).join(['verdict = ', '❌ FAIL', '']), 'fail')}, {_count(chr(39).join(['verdict = ', '⚠️ SUGGEST', '']), 'suggest')}, {_count(chr(39).join(['verdict = ', '🔶 REVIEW', '']), 'review')} FROM merged)")
def review_stats(spark, d):
    return verdicts.review_stats(a.entries(spark, d), _merged(spark, d))


_distinct = lambda v, name: f"CAST(count(DISTINCT key) FILTER (WHERE verdict = '{v}') AS BIGINT) AS {name}"


@query(_MERGED + f"SELECT CAST(count(DISTINCT key) AS BIGINT) AS total, {_distinct('❌ FAIL', 'fail')}, {_distinct('⚠️ SUGGEST', 'suggest')}, {_distinct('🔶 REVIEW', 'review')}, {_distinct('PASS', 'passed')} FROM merged")
def merged_stats(spark, d):
    store = _merged_once(spark, d).withColumns({"phase": F.lit("merged"), "filtered": F.lit(False)})
    other = store.withColumn("phase", F.lit("format"))
    return verdicts.merged_stats(store.unionByName(other))


@query(_MERGED + f", e AS (SELECT key, CASE WHEN namespace = '' THEN '__default__' ELSE namespace END AS namespace FROM entries) SELECT namespace, greatest(n, v) AS total, issues, fail, suggest, review FROM (SELECT namespace, CAST(count(*) AS BIGINT) AS v, {_count(chr(39).join(['verdict <> ', 'PASS', '']), 'issues')}, {_count(chr(39).join(['verdict = ', '❌ FAIL', '']), 'fail')}, {_count(chr(39).join(['verdict = ', '⚠️ SUGGEST', '']), 'suggest')}, {_count(chr(39).join(['verdict = ', '🔶 REVIEW', '']), 'review')} FROM merged JOIN e USING (key) GROUP BY 1) JOIN (SELECT namespace, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1) USING (namespace)")
def namespace_report(spark, d):
    return verdicts.namespace_report(_merged(spark, d), a.entries(spark, d))


@query(_ALL_RULES + " SELECT source, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY 1")
def source_distribution(spark, d):
    return verdicts.source_distribution(_found(spark, d))


@query(_MERGED + ", e AS (SELECT key, namespace FROM entries) SELECT CASE WHEN namespace = '' THEN '__default__' ELSE namespace END AS namespace, md5(concat('- ', verdict, ' `', key, '`: ', substring(en_current, 1, 120), ' → ', substring(zh_current, 1, 120), ' — ', reason)) AS digest FROM merged JOIN e USING (key)")
def report_lines(spark, d):
    lines = verdicts.report_lines(verdicts.normalized(_merged(spark, d), a.entries(spark, d)))
    return lines.select("namespace", F.md5("line").alias("digest"))


@query(_MERGED + "SELECT substring(key, 1, 60) AS key, substring(en_current, 1, 60) AS en_current, substring(zh_current, 1, 60) AS zh_current, verdict, substring(reason, 1, 60) AS reason FROM (SELECT * FROM merged WHERE verdict <> 'PASS' ORDER BY merged.key, merged.reason LIMIT 30)")
def issue_table(spark, d):
    return sinks.top_issues(_merged(spark, d))


_CACHE_KEY = "md5(concat(key, ':', verdict, ':', substring(zh_current, 1, 150), ':', substring(reason, 1, 200)))"


@query(_MERGED + f"SELECT key, {_CACHE_KEY} AS cache_key, verdict = '❌ FAIL' AS hit, CASE WHEN verdict = '❌ FAIL' THEN 'PASS' END AS action FROM merged")
def cache_split(spark, d):
    m = _merged_once(spark, d)
    cache = verdicts.with_cache_keys(m.where("verdict = '❌ FAIL'")).select("cache_key", F.lit("PASS").alias("action"), F.lit("").alias("reason"))
    return verdicts.split_by_cache(m, cache).select("key", "cache_key", "hit", "action")


@query(_MERGED + f"SELECT {_CACHE_KEY} AS cache_key, CASE WHEN verdict = '❌ FAIL' THEN 'PASS' ELSE 'KEEP' END AS action FROM merged")
def cache_upsert(spark, d):
    rows = verdicts.with_cache_keys(_merged_once(spark, d))
    new = rows.where("verdict = '❌ FAIL'").select("cache_key", F.lit("PASS").alias("action"))
    return verdicts.upsert(rows.select("cache_key", F.lit("KEEP").alias("action")), new, "cache_key")


@query(_MERGED + "SELECT key, CASE WHEN verdict = '❌ FAIL' THEN 'PASS' ELSE verdict END AS verdict, CASE WHEN verdict = '❌ FAIL' THEN 'ok' ELSE reason END AS reason, verdict = '❌ FAIL' AS filtered FROM merged")
def set_filtered(spark, d):
    store = _merged_once(spark, d).withColumns({"phase": F.lit("merged"), "filtered": F.lit(False)})
    decisions = store.where("verdict = '❌ FAIL'").select("key", F.lit("PASS").alias("verdict"), F.lit("ok").alias("reason"))
    return verdicts.set_filtered(store, decisions).select("key", "verdict", "reason", "filtered")


# ---- history
_RUNS = """r AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR lag(v) OVER w <> v THEN 1 ELSE 0 END AS new FROM {0} WINDOW w AS (PARTITION BY k ORDER BY {1})), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY k ORDER BY {1}) AS BIGINT) AS nth FROM r),
 runs AS (SELECT k, v, arg_min(ver, (tm, id)) AS version_start, arg_max(ver, (tm, id)) AS version_end, nth FROM s GROUP BY k, v, nth), iv AS (SELECT *, CASE WHEN max(nth) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS changes FROM runs) """
_ORDERS = "WITH o AS (SELECT o_custkey AS k, o_orderstatus AS v, o_orderkey AS ver, o_orderdate AS tm, o_orderkey AS id FROM orders), " + _RUNS.format("o", "tm, id")


def _order_runs(spark, d):
    return history.intervals(a.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus"], "o_orderkey")


@query(_ORDERS + "SELECT k AS o_custkey, v AS o_orderstatus, version_start, version_end, changes, nth FROM iv")
def version_islands(spark, d):
    return _order_runs(spark, d)


@query(_ORDERS + "SELECT k AS o_custkey, v AS o_orderstatus, version_start, version_end, changes, nth FROM iv")
def version_islands_extended(spark, d):
    """As version_islands, of which a part of the rows comes later, some after and some between those of their keys."""
    orders = a.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    same = (["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus"], "o_orderkey")
    early = (F.col("o_orderkey") % 5 != 0) & ((F.col("o_custkey") % 2 == 0) | (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")))
    old, new = orders.where(early), orders.where(~early)
    return history.extend_intervals(cut(history.intervals(old, *same, with_end=True)), old, new, *same).drop("end")


@query(_ORDERS + "SELECT CAST(count(*) AS BIGINT) AS n_intervals, CAST(count(*) FILTER (WHERE changes = 1) AS BIGINT) AS n_changed_rows, CAST(count(DISTINCT k) AS BIGINT) AS n_keys, CAST(count(DISTINCT k) FILTER (WHERE changes = 1) AS BIGINT) AS n_changed_keys FROM iv")
def island_stats(spark, d):
    return history.interval_stats(_order_runs(spark, d), ["o_custkey"])


@query("WITH o AS (SELECT user_id AS k, event_type AS v, event_id AS ver, ts AS tm, event_id AS id FROM events), " + _RUNS.format("o", "tm, id") + "SELECT k AS user_id, v AS event_type, version_start, version_end, changes, nth FROM iv")
def event_islands(spark, d):
    return history.intervals(a.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"], "event_id")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 1 ELSE 0 END AS changes FROM orders GROUP BY 1")
def version_change_flag(spark, d):
    return _order_runs(spark, d).select("o_custkey", "changes").distinct()


@query("SELECT part.p_partkey, [CAST(p_size AS INTEGER), CAST(p_partkey % 100 AS INTEGER)] AS version FROM part")
def version_parse(spark, d):
    return a.table(spark, d, "part").select("p_partkey", t.version_parts(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 100).cast("string"))).alias("version"))


# ---- external review
_ANSWER = """CASE event_id % 3 WHEN 0 THEN concat('[{"key": "', CAST(event_id AS STRING), '", "verdict": "PASS", "reason": "', event_type, '"}]') WHEN 1 THEN concat('Here: [{"key": "', CAST(event_id AS STRING), '", "verdict": "FAIL", "reason": "', event_type, '"}] done') ELSE concat('nothing ', event_type) END"""


@query("SELECT event_id, CAST(event_id AS STRING) AS key, CASE event_id % 3 WHEN 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, event_type AS reason FROM events WHERE event_id % 3 < 2")
def json_tolerant_parse(spark, d):
    return review.parse_answers(a.table(spark, d, "events").selectExpr("event_id", f"{_ANSWER} AS answer"))


@query("SELECT event_id, event_id % 2 = 0 AS truncated FROM events")
def truncated_json(spark, d):
    return a.table(spark, d, "events").select("event_id", t.truncated_json(F.when(F.col("event_id") % 2 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))).alias("truncated"))


def stub(prompt: str) -> str:
    """A deterministic reviewer: what it says of a key depends on the key alone."""
    import json
    import re

    keys = re.findall(r"key: `([^`]*)`", prompt)
    return json.dumps([{"key": k, "verdict": "PASS" if len(k) % 2 else "⚠️ SUGGEST", "reason": f"about {k}"} for k in keys], ensure_ascii=False)


@query(f"WITH {a.PARTS_SQL} SELECT key, CASE WHEN length(key) % 2 = 1 THEN 'PASS' ELSE '⚠️ SUGGEST' END AS verdict, concat('about ', key) AS reason, 'llm_review' AS source FROM parts")
def external_review_stub(spark, d):
    made = routing.prompts(routing.entry_blocks(a.parts(spark, d).select("key", "en", "zh")), F.col("label"))
    return review.review(made, stub).select("key", "verdict", "reason", "source")


@query(f"WITH {a.PARTS_SQL} SELECT key FROM parts WHERE pos % 2 = 0")
def unanswered(spark, d):
    parts = a.parts(spark, d)
    made = routing.prompts(routing.entry_blocks(parts.select("key", "en", "zh")), F.col("label"))
    return review.unanswered(made, parts.where("pos % 2 = 1").select("key"))


# ---- answers about terms
def merge_stub(prompt: str) -> str:
    """A reviewer that merges each cluster into its first term."""
    import json

    groups = [[x[4:] for x in g.split("\n") if x.startswith("  - ")] for g in prompt.split("## 候选组 ")[1:]]
    return json.dumps([{"canonical": g[0], "members": g} for g in groups])


def verify_stub(prompt: str) -> str:
    """A reviewer that corrects the terms that it is shown five texts of."""
    import json
    import re

    found = re.findall(r'Term: "([^"]*)" -> "([^"]*)"\n((?:  \[\d\] .*\n)+)', prompt + "\n")
    return "Sure:\n```json\n" + json.dumps([{"en": en, "old_zh": zh, "new_zh": f"{zh}改"} for en, zh, lines in found if lines.count("  [") == 5], ensure_ascii=False) + "\n```"


@query(f"WITH {_BUCKETS} SELECT norm, first_value(norm) OVER (PARTITION BY left(norm, 1) ORDER BY freq DESC, norm) AS target FROM buckets")
def lemma_merge_answers(spark, d):
    buckets = _buckets(spark, d).select("norm", "freq")
    return lemma.ask_merges(buckets.select("norm", F.left("norm", F.lit(1)).alias("cluster")), buckets, merge_stub)


@query(f"""WITH {_BUCKETS}, m AS (SELECT norm, first_value(norm) OVER (PARTITION BY left(norm, 1) ORDER BY freq DESC, norm) AS target FROM buckets),
 old AS (SELECT norm AS variant, right(norm, 1) AS canonical FROM buckets), ok AS (SELECT norm AS variant, target AS t FROM m WHERE length(norm) > 2 AND norm NOT IN {_STOPS} AND length(target) > 2 AND target NOT IN {_STOPS}),
 learned AS (SELECT * FROM ok UNION SELECT t, t FROM ok), now AS (SELECT variant, coalesce(t, canonical) AS canonical FROM old FULL JOIN learned USING (variant)), gained AS (SELECT t AS canonical, count(*) AS n FROM learned GROUP BY 1),
 lost AS (SELECT canonical, count(*) AS n FROM old JOIN learned USING (variant) WHERE variant <> t GROUP BY 1)
 SELECT canonical, list_sort(list(variant)) AS variants, CAST(any_value(CASE WHEN canonical IN (SELECT canonical FROM old) THEN greatest(0, 3 - coalesce(lost.n, 0)) ELSE 0 END + coalesce(gained.n, 0)) AS BIGINT) AS freq FROM now LEFT JOIN lost USING (canonical) LEFT JOIN gained USING (canonical) GROUP BY canonical""")
def lemma_cache_record(spark, d):
    """Merges that a reviewer made, learned by a cache in which terms with one last letter belonged together."""
    buckets = _buckets(spark, d).select("norm", "freq")
    merges = lemma.ask_merges(buckets.select("norm", F.left("norm", F.lit(1)).alias("cluster")), buckets, merge_stub)
    cache = buckets.groupBy(F.right("norm", F.lit(1)).alias("canonical")).agg(F.collect_list("norm").alias("variants"), F.lit(3).cast("long").alias("freq"))
    return lemma.record_merges(cache, merges)


@query(f"WITH {a.PARTS_SQL}, g AS (SELECT w, count(DISTINCT en) AS n FROM (SELECT unnest(string_split(en, ' ')) AS w, en FROM parts) GROUP BY 1) SELECT w AS en, concat(w, '料', CASE WHEN n >= 4 THEN '改' ELSE '' END) AS zh FROM g")
def glossary_verify(spark, d):
    parts = a.parts(spark, d)
    words = parts.select(F.explode(F.split("en", " ")).alias("en")).distinct().select("en", F.concat("en", F.lit("料")).alias("zh"))
    return lemma.verify_glossary(words, parts.select("key", "en", "zh", "pos"), verify_stub)


@query("WITH c AS (SELECT split_part(p_type, ' ', 1) AS canonical, split_part(p_name, ' ', 1) AS v, count(*) AS n FROM part GROUP BY 1, 2) SELECT canonical, list_transform(list_sort(list(DISTINCT {'n': length(v), 'v': v})), lambda x: x.v) AS variants, CAST(sum(n) AS BIGINT) AS freq FROM c GROUP BY 1")
def lemma_cache_rows(spark, d):
    cache = a.table(spark, d, "part").groupBy(F.expr("split_part(p_type, ' ', 1)").alias("canonical"), F.expr("split_part(p_name, ' ', 1)").alias("v")).agg(F.count("*").alias("freq"))
    return sinks.lemma_cache_rows(cache.select("canonical", F.array("v").alias("variants"), "freq"))


# ---- changes and reports
_plain = lambda c: rf"replace(replace(replace(replace({c}, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
_repr = lambda c: f"""CASE WHEN contains({c}, '''') AND NOT contains({c}, '"') THEN concat('"', {_plain(c)}, '"') ELSE concat('''', replace({_plain(c)}, '''', '\\'''), '''') END"""


@query(_DIFF + f", w AS (SELECT key, substring(coalesce(old_en, ''), 1, 60) AS a, substring(en, 1, 60) AS b FROM changes WHERE warning IS NOT NULL) SELECT key, '' AS en_current, '' AS zh_current, '⚠️ SUGGEST' AS verdict, '' AS suggestion, concat('原文变更但翻译未变更。旧EN: ', {_repr('a')}, ' → 新EN: ', {_repr('b')}) AS reason, 'pr_warning' AS source FROM w")
def change_warning_verdicts(spark, d):
    return align.change_warnings(_changes(spark, d))


@query(_DIFF + f"SELECT {_count(f'NOT {_GONE}', 'total_changed_keys')}, {_count(_GONE, 'deleted_keys')}, {_count(f'NOT {_GONE} AND old_en IS NOT NULL', 'en_changed')}, {_count(f'NOT {_GONE} AND old_zh IS NOT NULL', 'zh_changed')}, {_count('warning IS NOT NULL', 'zh_unchanged_warnings')}, {_count(f'NOT {_GONE} AND starts_with(key, {chr(39)}ae2guide:{chr(39)})', 'guide_entries')}, CAST(count(DISTINCT CASE WHEN NOT {_GONE} THEN right(key, 1) END) AS BIGINT) AS namespaces FROM changes")
def change_summary(spark, d):
    return sinks.change_summary(_changes(spark, d).withColumn("namespace", F.right("key", F.lit(1))))


_REPORT = ", e AS (SELECT key, CASE WHEN namespace = '' THEN '__default__' ELSE namespace END AS namespace FROM entries), v AS (SELECT merged.*, namespace FROM merged JOIN e USING (key)), report AS (SELECT namespace, greatest(n, v) AS total, issues, fail, suggest, review FROM (SELECT namespace, count(*) AS v, " + ", ".join(f"count(*) FILTER (WHERE verdict {op} '{x}') AS {name}" for op, x, name in (("<>", "PASS", "issues"), ("=", "❌ FAIL", "fail"), ("=", "⚠️ SUGGEST", "suggest"), ("=", "🔶 REVIEW", "review"))) + " FROM v GROUP BY 1) JOIN (SELECT namespace, count(*) AS n FROM e GROUP BY 1) USING (namespace))"
_HEAD = "concat('# ', namespace, ' — 翻译审校报告'), '', concat('- 条目总数：', total), concat('- 问题：', issues, ' 处'), concat('- ❌ FAIL：', fail), concat('- ⚠️ SUGGEST：', suggest), concat('- 🔶 REVIEW：', review), '', '## 问题清单', '', '| 判定 | 键名 | 问题 |', '|------|------|------|'"


@query(_MERGED + _REPORT + f", lines AS (SELECT namespace, CAST(unnest(range(1, 13)) AS INTEGER) AS nth, unnest([{_HEAD}]) AS line FROM report WHERE issues > 0 AND namespace <> '__default__' UNION ALL SELECT namespace, CAST(12 + row_number() OVER (PARTITION BY namespace ORDER BY CASE verdict WHEN '❌ FAIL' THEN 0 ELSE 1 END, key, reason) AS INTEGER), concat('| ', verdict, ' | `', key, '` | ', reason, ' |') FROM v WHERE verdict <> 'PASS' AND namespace <> '__default__') SELECT namespace, nth, md5(line) AS digest FROM lines")
def namespace_pages(spark, d):
    e = a.entries(spark, d)
    merged = cut(_merged(spark, d))
    pages = verdicts.namespace_pages(verdicts.normalized(merged, e), verdicts.namespace_report(merged, e))
    return pages.select("namespace", "nth", F.md5("line").alias("digest"))


@query(_MERGED + _REPORT + """, p AS (SELECT 0 AS part, '' AS name, unnest(range(0, 11)) AS seat, unnest(['# 翻译审校报告', '', concat('共审校 **', (SELECT count(*) FROM entries), '** 条翻译，发现 **', count(*), '** 处问题：'), concat('- ❌ FAIL：', count(*) FILTER (WHERE verdict = '❌ FAIL'), ' 处（必须修复）'), concat('- ⚠️ SUGGEST：', count(*) FILTER (WHERE verdict = '⚠️ SUGGEST'), ' 处（建议改进）'), concat('- 🔶 REVIEW：', count(*) FILTER (WHERE verdict = '🔶 REVIEW'), ' 处（需人工判断）'), '', '## 按模组统计', '', '| 模组 | 总计 | 问题 | ❌ FAIL | ⚠️ SUGGEST | 🔶 REVIEW |', '|------|------|------|---------|-----------|----------|']) AS line FROM merged
 UNION ALL SELECT 1, namespace, 0, concat('| ', namespace, ' | ', total, ' | ', issues, ' | ', fail, ' | ', suggest, ' | ', review, ' |') FROM report
 UNION ALL SELECT 2, '', unnest(range(0, 5)), unnest(['', '## ⚠️ 兼容性警告', '', '以下模组本次 PR 删除了旧 key，使用旧版模组翻译的玩家可能遇到 key 缺失：', '']) UNION ALL SELECT 2, namespace, 5, concat('- **', namespace, '**：删除 ', total, ' 个 key') FROM report
 UNION ALL SELECT 3, '', unnest(range(0, 3)), unnest(['', '## 各模组详细报告', '']) UNION ALL SELECT 4, namespace, 0, concat('- [', namespace, '](', namespace, '_report.md)') FROM report WHERE namespace <> '__default__' UNION ALL SELECT 5, '', unnest(range(0, 3)), unnest(['', '', '> 完整数据见 report.json，可筛选查询所有 verdict 详情。']))
 SELECT CAST(row_number() OVER (ORDER BY part, CASE part WHEN 2 THEN seat ELSE 0 END, name, seat) AS INTEGER) AS nth, line FROM p""")
def summary_page(spark, d):
    """The page of a change in which each namespace lost as many keys as it has entries."""
    e = a.entries(spark, d)
    merged = cut(_merged(spark, d))
    report = cut(verdicts.namespace_report(merged, e))
    return verdicts.summary_page(e, merged, report, report.select("namespace", F.col("total").alias("deletions")))


# ---- what prompts hold
@query(f"""WITH {_DICT}, {a.PARTS_SQL}, w AS (SELECT key, word, min(seat) AS seat FROM (SELECT key, unnest(regexp_extract_all(en, '[A-Za-z]+')) AS word, unnest(range(0, len(regexp_extract_all(en, '[A-Za-z]+')))) AS seat FROM parts) WHERE lower(word) NOT IN {_STOPS} GROUP BY 1, 2),
 n AS (SELECT lower(origin_name) AS word, trans_name AS zh, count(DISTINCT modid) AS n, list_sort(list(DISTINCT modid)) AS ids FROM dict GROUP BY 1, 2), r AS (SELECT key, w.word, zh, ids, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, seat, zh) AS nth FROM w JOIN n ON lower(w.word) = n.word)
 SELECT key, concat('  外部词典: ', string_agg(concat('"', word, '" -> "', zh, '" 来源Mod: [', array_to_string(ids[1:5], ', '), CASE WHEN n > 5 THEN concat(' +', n - 5) ELSE '' END, ']'), ' | ' ORDER BY nth)) AS known FROM r WHERE nth <= 3 GROUP BY key""")
def dictionary_lines(spark, d):
    dictionary = a.table(spark, d, "part").selectExpr("split_part(p_name, ' ', 1) AS origin_name", "p_type AS trans_name", "p_brand AS modid")
    return routing.dictionary_lines(a.parts(spark, d).select("key", "en"), dictionary)


_FOCUS = "CASE prefix " + " ".join("WHEN '{}' THEN '{}'".format(p, x.replace("'", "''")) for p, x in FOCUS.items()) + f" ELSE '{OTHER_FOCUS}' END"
_KEYS, _MICE = r"'(?i)\b(Shift|Ctrl|Alt|Tab)\b'", r"'(?i)\b(?:left\s*click|right\s*click|left[- ]?mouse|right[- ]?mouse|mouse\s*button|scroll\s*wheel|drag|double[-\s]?click|middle\s*click|mouse\s*over|hover)\b|(?:左键|右键|鼠标|单击|双击|点击|拖拽|滚轮)'"


@query(f"""WITH {a.ENTRIES_SQL}, b AS (SELECT *, (row_number() OVER (PARTITION BY prefix ORDER BY key) - 1) // CASE prefix WHEN 'ae2guide:' THEN 1 ELSE 3 END AS batch FROM (SELECT key, en, zh, {_PREFIX} AS prefix FROM entries)), m AS (SELECT prefix, batch, count(*) AS n, bool_or(regexp_matches(en, {_KEYS})) AS keyboard, bool_or(regexp_matches(concat(en, zh), {_MICE})) AS mouse, string_agg(key, concat(chr(10), chr(10)) ORDER BY key) AS body FROM b GROUP BY 1, 2)
 SELECT prefix, CAST(batch AS BIGINT) AS batch, CAST(n AS INTEGER) AS n, concat({_LABEL}, '|', {_FOCUS}, '|', concat_ws(chr(10), CASE WHEN keyboard THEN '{KEYBOARD_GUIDANCE}' END, CASE WHEN mouse THEN '{MOUSE_GUIDANCE}' END), chr(10), chr(10), body) AS prompt FROM m""")
def prompt_headers(spark, d):
    e = a.entries(spark, d)
    made = routing.prompts(e.select("key", F.col("key").alias("block")), F.concat("label", F.lit("|"), "focus", F.lit("|"), "guidance"), size=3, entries=e)
    return made.select("prefix", "batch", "n", "prompt")


@query(f"WITH {a.ENTRIES_SQL}, found AS ({_rule_sql(_RULE_SQL)}) SELECT key, CASE WHEN key IN (SELECT key FROM found) THEN 'flagged' WHEN {_REQUIRED} THEN 'required' ELSE 'pass' END AS route FROM entries")
def route_without_terms(spark, d):
    """A glossary that has no terms leaves no entry uncovered."""
    e = a.entries(spark, d)
    return routing.route(e.select("key", "en", "zh"), rules.check_entries(e), spark.createDataFrame([], "en string, zh string")).select("key", "route")


_RANKED = """words AS (SELECT key, lower(unnest(regexp_extract_all(concat(key, ' ', en, ' ', zh), '[A-Za-z0-9]+'))) AS token FROM mem), tf AS (SELECT key, token, count(*) AS tf FROM words GROUP BY 1, 2), size AS (SELECT key, count(*) AS d FROM words GROUP BY 1), every AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
 pre AS (SELECT DISTINCT q_key, query, unnest(string_split(lower(query), ' ')) AS prefix FROM q), il AS (SELECT prefix, key, sum(tf) AS tf FROM (SELECT DISTINCT prefix FROM pre WHERE length(prefix) >= 2) JOIN tf ON starts_with(token, prefix) GROUP BY 1, 2), df AS (SELECT prefix, count(*) AS df FROM il GROUP BY 1),
 sc AS (SELECT q_key, query, key, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / mean))), 6) AS score FROM pre JOIN il USING (prefix) JOIN df USING (prefix) JOIN size USING (key), every GROUP BY 1, 2, 3),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY score DESC, key) AS r FROM sc) WHERE r <= 50)"""


@query(f"WITH {_MEMORY}, {_RANKED}, s AS (SELECT q_key, key, en, zh, round_even(100.0::DOUBLE * (1.0::DOUBLE - levenshtein(query, en)::DOUBLE / greatest(length(query), length(en))), 2) AS similarity FROM best JOIN mem USING (key)) SELECT q_key, CAST(nth AS INTEGER) AS nth, similarity, key, en, zh FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY similarity DESC, key) AS nth FROM s WHERE similarity >= 20) WHERE nth <= 5")
def fuzzy_ranked(spark, d):
    """As fuzzy_topk, among the 50 most relevant lines of each query."""
    mem, q = _memory(spark, d)
    return fuzzy.fuzzy_search(q, mem, replace(DEFAULTS, fuzzy_threshold=20.0))


@query(f"WITH {_BUCKETS} SELECT norm, nth AS rank FROM (SELECT norm, row_number() OVER (ORDER BY len(keys) DESC, norm) AS nth FROM buckets) WHERE nth <= 10")
def top_buckets(spark, d):
    return terms.top_buckets(_buckets(spark, d).select("norm", "keys"), replace(DEFAULTS, cluster_top=10))


@query(f"WITH {a.ENTRIES_SQL} SELECT key, starts_with(key, 'ae2guide:') AS guide, ({' OR '.join(f'contains(key, {chr(39)}{x}{chr(39)})' for x in DEFAULTS.fuzzy_triggers)}) AS fuzzy, {_REQUIRED} AS required FROM entries")
def key_flags(spark, d):
    key = F.col("key")
    return a.entries(spark, d).select("key", t.is_guide(key).alias("guide"), t.fuzzy_trigger(key).alias("fuzzy"), t.needs_review(key, F.col("en")).alias("required"))


@query("SELECT o_orderstatus AS canonical, [o_orderstatus] AS variants, CAST(10 + count(*) AS BIGINT) AS freq FROM orders GROUP BY 1")
def lemma_cache_fold(spark, d):
    orders = a.table(spark, d, "orders").select(F.col("o_orderstatus").alias("canonical"))
    cache = orders.distinct().select("canonical", F.array("canonical").alias("variants"), F.lit(10).cast("long").alias("freq"))
    return sinks.fold_lemma_cache(cache, orders)


@query(_MERGED + "SELECT CAST(count(*) AS BIGINT) AS decisions, CAST(count(*) FILTER (WHERE verdict = '❌ FAIL') AS BIGINT) AS dismissed FROM merged")
def cache_totals(spark, d):
    m = _merged(spark, d)
    return verdicts.cache_size(m.select(F.when(F.col("verdict") == "❌ FAIL", "PASS").otherwise("KEEP").alias("action")))


# ---- sources
@query("SELECT CAST(p_partkey AS STRING) AS key, concat(p_name, '=', p_type) AS value, CAST(1 AS BIGINT) AS pos FROM part WHERE p_name IS NOT NULL")
def lang_parse(spark, d):
    text = F.concat(F.lit("# c\nfirst = 1\n"), F.col("p_partkey").cast("string"), F.lit(" = "), "p_name", F.lit("=\\\n"), "p_type", F.lit("\n\n! x"))
    rows = files.map_rows(a.table(spark, d, "part").select(text.alias("value")), "lang")
    return rows.where("key <> 'first'").select("key", "value", "pos")


@query("SELECT CAST(p_partkey AS STRING) AS key, p_type AS value, 'repeated key ''' || CAST(p_partkey AS STRING) || ''': the last value counts' AS warning FROM part")
def json_map_parse(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{"_comment": "c", "'), k, F.lit('": "'), "p_name", F.lit('", "'), k, F.lit('": "'), "p_type", F.lit('"}'))
    return files.map_rows(a.table(spark, d, "part").select(text.alias("value")), "json").select("key", "value", "warning")


@query("SELECT CAST(p_partkey AS STRING) AS key, p_type AS value FROM part UNION ALL SELECT concat('_comment', CAST(p_partkey AS STRING)), p_name FROM part")
def json_plain_parse(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{"_comment'), k, F.lit('": "'), "p_name", F.lit('", "'), k, F.lit('": "'), "p_type", F.lit('"}'))
    return files.map_rows(a.table(spark, d, "part").select(text.alias("value")), "plain").select("key", "value")


@query("SELECT concat('a=', CAST(p_partkey AS STRING), ':b') AS key, concat(p_name, chr(10), 'é=') AS value FROM part")
def lang_escapes(spark, d):
    text = F.concat(F.lit("#PARSE_ESCAPE\na\\="), F.col("p_partkey").cast("string"), F.lit("\\:b="), "p_name", F.lit("\\n\\u00e9\\="))
    return files.map_rows(a.table(spark, d, "part").select(text.alias("value")), "lang").select("key", "value")


@query("""WITH best AS (SELECT user_id, event_type, arg_max(CASE WHEN event_id % 3 = 0 THEN 'PASS' ELSE 'KEEP' END, event_id) AS action, max(event_id) AS ord FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2)
 SELECT CAST(user_id AS STRING) AS key, event_type, action, CAST(count(*) AS BIGINT) AS n, CAST(any_value(ord) AS STRING) AS reason FROM events JOIN best USING (user_id, event_type) GROUP BY ALL""")
def filter_stream(spark, d):
    """Events as a stream of verdicts and, a part of them, as a stream of decisions, met in a state store by the cache's key; what the stream answered."""
    state.use_rocksdb(spark)
    # a pattern, as a stream takes a folder or what a pattern finds, and the table may be one file
    schema, at = a.table(spark, d, "events").schema, scratch_path(spark)
    row = lambda: spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").selectExpr("event_id", "CAST(user_id AS STRING) AS key", "event_type AS verdict", "'' AS zh_current", "event_type AS reason")
    made = verdicts.with_cache_keys(row().where("event_id % 4 = 0")).select("cache_key", F.when(F.col("event_id") % 3 == 0, "PASS").otherwise("KEEP").alias("action"), F.concat_ws(" ", F.col("event_id").cast("string"), "reason").alias("reason"), F.col("event_id").alias("ord"))
    state.store(state.decided(row(), made), f"{at}/answers", f"{at}/checkpoint").awaitTermination()
    said = F.split("reason", " ")
    return spark.read.schema(state.DECIDED).parquet(f"{at}/answers").groupBy("key", said[1].alias("event_type"), "action", said[0].alias("reason")).agg(F.count("*").alias("n"))


# ---- plans
def _keyed_parts(spark, d):
    return a.parts(spark, d).select("key", "en", "zh", F.col("p_brand").alias("namespace"), "pos")


@query()
def review_plan(spark, d):
    """The whole plan with the deterministic reviewer (no SQL: it ends in a Python callable); its parts have SQL of their own."""
    return run_review(_keyed_parts(spark, d), stub).merged.select("key", "verdict", "reason", "source")


@query()
def review_plan_offline(spark, d):
    return run_review(_keyed_parts(spark, d)).by_namespace


@query(_MERGED + "SELECT key, CASE WHEN length(key) % 2 = 1 THEN 'PASS' ELSE verdict END AS verdict, CASE WHEN length(key) % 2 = 1 THEN '' ELSE concat('about ', key) END AS reason FROM merged")
def filter_plan(spark, d):
    cache = spark.createDataFrame([], "cache_key string, action string, reason string")
    return run_filter(_merged(spark, d), cache, stub)[0].select("key", "verdict", "reason")


@query(_MERGED + f", e AS (SELECT key, CASE WHEN namespace = '' THEN '__default__' ELSE namespace END AS namespace FROM entries) SELECT namespace, {_count(chr(39).join(['verdict = ', '❌ FAIL', '']), 'fail')}, CAST(count(*) AS BIGINT) AS n FROM merged JOIN e USING (key) GROUP BY 1")
def flagship(spark, d):
    """Aligned entries, all rules, one verdict a key, counts by namespace."""
    rows = verdicts.normalized(_merged(spark, d), a.entries(spark, d))
    return rows.groupBy("namespace").agg(F.count_if(F.col("verdict") == "❌ FAIL").alias("fail"), F.count("*").alias("n"))
