"""The engine's queries over the test tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions import text as tx
from gramlode.functions.grams import fnv1a
from gramlode.operators import freshness, render
from gramlode.operators import index as ix
from gramlode.operators import search as se
from gramlode.plans import gram_plan as gp
from gramlode.plans.regex import to_java
from gramlode.sources import corpus as co
from gramlode.sources import storage

Query = Callable[[SparkSession, str], DataFrame]

#: Tables have no files to skip for their size.
NO_LIMIT = (1 << 63) - 1

_built: dict[tuple[str, str], ix.Index] = {}


def _sweep() -> None:
    for index in _built.values():
        try:
            storage.delete(index.spark, index.path)
        except Exception:  # the session may be gone before us
            return


def indexed(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of the documents, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        if not _built:
            atexit.register(_sweep)
        _built[key] = ix.build(co.documents_corpus(spark, sf_dir), storage.scratch(spark), NO_LIMIT)
    return _built[key]


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return co.table_corpus(p, p.page_id, p.url, p.html)


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return co.table_corpus(c, F.xxhash64("conv_id", "turn"), F.concat(c.conv_id.cast("string"), F.lit("/"), F.lpad(c.turn.cast("string"), 4, "0"), F.lit("/"), c.role), c.text)


def parts_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return co.table_corpus(p, p.p_partkey, F.concat(p.p_brand, F.lit("/"), F.lpad(p.p_partkey.cast("string"), 9, "0")), p.p_name)


def flat(matches: DataFrame) -> DataFrame:
    """Context as joined strings."""
    return matches.withColumn("context_before", F.array_join("context_before", "\n")).withColumn("context_after", F.array_join("context_after", "\n"))


# ---- SQL

PATH = "concat(source, '/', lang, '/', lpad(doc_id::varchar, 8, '0'), '.txt')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FILES = f"files AS (SELECT doc_id AS file_id, {PATH} AS path, strlen(text) AS size, text FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents))"


def lines_sql(files: str = FILES) -> str:
    return f"""{files}, split AS (SELECT path, list_transform(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END, lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM (SELECT path, string_split(text, chr(10)) AS p FROM files)),
lines AS (SELECT path, ls, unnest(ls) AS line_text, generate_subscripts(ls, 1) AS n FROM split)"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def search_sql(pattern: str, *, path_filter: str | None = None, files_only: bool = False, before: int = 0, after: int = 0, limit: int | None = None, files: str = FILES) -> str:
    where = f"regexp_matches(line_text, {quoted(pattern)})" + (f" AND regexp_matches(path, {quoted(path_filter)})" if path_filter else "")
    if files_only:
        return f"WITH {lines_sql(files)} SELECT DISTINCT path, 0::int AS line_number, '' AS line_text, '' AS context_before, '' AS context_after FROM lines WHERE {where}"
    b = f"array_to_string(ls[greatest(n - {before}, 1):n - 1], chr(10))" if before else "''"
    a = f"array_to_string(ls[n + 1:n + {after}], chr(10))" if after else "''"
    tail = f" ORDER BY path, line_number LIMIT {limit}" if limit is not None else ""
    return f"WITH {lines_sql(files)} SELECT path, n::int AS line_number, line_text, {b} AS context_before, {a} AS context_after FROM lines WHERE {where}{tail}"


# ---- searches: name, (pattern, flags, pattern for SQL)

SEARCHES: dict[str, tuple[str, dict, str | None]] = {
    "search_literal": ("MIT License", {}, None),
    "search_regex": ("that.*the", {}, None),
    "search_alternation": ("(theren|eaux) (de|the)", {}, None),
    "search_class": ("[0-9]{3}", {}, None),
    "search_anchor": ("^The [a-z]+", {}, None),
    "search_empty": ("zqxjkv", {}, None),
    "search_at": ("[0-9]+@mail[0-9]", {}, None),
    "search_escape": (r"\+1 \([0-9]{3}\) 555", {}, None),
    "search_ignorecase": ("mit license", {"ignore_case": True}, "(?i)mit license"),
    "search_ignorecase_unicode": ("Étr|ÄCH", {"ignore_case": True}, "(?i)Étr|ÄCH"),
    "search_path_filter": ("theren", {"path_filter": r"^src1[0-9]*/en/.*[05]\.txt$"}, None),
    "search_files_only": ("License", {"files_only": True, "before": 2, "after": 2}, None),
    "search_context": ("License", {"before": 2, "after": 2}, None),
    "search_before": ("@mail", {"before": 1}, None),
    "search_after": ("@mail", {"after": 1}, None),
    "search_ctx_override": ("555-[0-9]{4}", {"before": 5, "after": 1}, None),
    "search_limit": ("[a-z]", {"limit": 50}, None),
    "search_limit_context": ("the", {"limit": 20, "before": 1, "after": 1}, None),
}


def _search(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pattern, flags, _ = SEARCHES[name]
    return flat(se.search(indexed(spark, sf_dir), co.documents_corpus(spark, sf_dir), pattern, **flags))


def _search_sql(name: str) -> str:
    pattern, flags, sql_pattern = SEARCHES[name]
    return search_sql(sql_pattern or pattern, **{k: v for k, v in flags.items() if k != "ignore_case"})


PLANS = {
    "cand_lookup": gp.Lookup(0x746865),  # the
    "cand_and": gp.plan_of("theren"),
    "cand_or": gp.plan_of("License|@mail"),
    "cand_nested": gp.plan_of("(theren|eaux)tion|zqx"),
    "cand_miss": gp.plan_of("zqxjk"),
    "cand_fullscan": gp.plan_of("[0-9]+"),
}


def plan_sql(plan: gp.Plan) -> str:
    match plan:
        case gp.Lookup(gram):
            return f"contains({LOWER}, {quoted(gp.gram_bytes(gram).decode())})"
        case gp.FullScan():
            return "true"
    return "(" + (" AND " if isinstance(plan, gp.And) else " OR ").join(map(plan_sql, plan.parts)) + ")"


def _candidates(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return index.files.join(se.candidates(index, PLANS[name]), "file_id", "left_semi").select("file_id", "path")


# ---- index


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.documents_corpus(spark, sf_dir).select("file_id", "path", "size")


def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.dense_ids(co.documents_corpus(spark, sf_dir).select("path")).select("path", F.col("dense_id").alias("file_id"))


LIMIT = 2000


def index_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.with_status(co.documents_corpus(spark, sf_dir), LIMIT).groupBy("status").agg(F.count("*").alias("n"))


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(co.documents_corpus(spark, sf_dir))


#: Byte windows of the texts as hex digits, ASCII-lowered.
GRAMS_SQL = f"""hexed AS (SELECT doc_id, hex(encode({LOWER})) AS h FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), lists AS (
SELECT doc_id, list_distinct(list_transform(range(0, greatest(length(h) // 2 - 2, 0)), lambda i: substr(h, 2 * i + 1, 6))) AS gs FROM hexed), postings AS (
SELECT doc_id AS file_id, ('0x' || unnest(gs))::int AS gram FROM lists)"""


def gram_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_postings(spark, sf_dir)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = document_postings(spark, sf_dir)
    return p.agg(F.countDistinct("file_id").alias("file_count"), F.countDistinct("gram").alias("ngram_count"), F.count("*").alias("total_ngrams"))


def index_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = indexed(spark, sf_dir).meta
    return spark.createDataFrame([(m["file_count"], m["ngram_count"], m["total_ngrams"], m["skipped_binary"], m["skipped_large"])], "file_count long, ngram_count long, total_ngrams long, skipped_binary long, skipped_large long")


def gram_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_postings(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "gram").limit(100)


def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.posting_lists(document_postings(spark, sf_dir)).select("gram", F.array_join(F.transform("file_ids", lambda x: x.cast("string")), ",").alias("file_ids"))


def posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.posting_gaps(document_postings(spark, sf_dir))


def posting_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    gaps = posting_gaps(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("gram").orderBy("file_id"))).drop("file_id")
    return ix.from_gaps(gaps).select("gram", "file_id")


def posting_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_gaps(spark, sf_dir).groupBy("gram").agg(F.sum(ix.varint_bytes(F.col("gap"))).alias("n_bytes"))


def gram_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(g, f"{fnv1a(g.encode()):016x}") for g in ("abc", "def", "fn ", "")], "gram string, hash string")


# ---- search variants


def search_no_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(se.scan(co.documents_corpus(spark, sf_dir), "that.*the"))


def indexed_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the index finds and the scan does not, or the other way round: none."""
    corpus = co.documents_corpus(spark, sf_dir)
    key = ("path", "line_number")
    a = se.search(indexed(spark, sf_dir), corpus, "License|eaux.*de la", scan_share=1.0, ordered=False).select(*key)
    b = se.scan(corpus, "License|eaux.*de la", ordered=False).select(*key)
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_lines(se.search(indexed(spark, sf_dir), co.documents_corpus(spark, sf_dir), "License", before=1, after=1))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.text(se.search(indexed(spark, sf_dir), co.documents_corpus(spark, sf_dir), "License", before=1, after=1))


def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = se.search(indexed(spark, sf_dir), co.documents_corpus(spark, sf_dir), "Lic[a-z]+")
    return m.select("path", "line_number", tx.highlighted(F.col("line_text"), to_java("Lic[a-z]+")).alias("text"))


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    name, n = se.mode(index, "License")
    return se.summary(se.search(index, co.documents_corpus(spark, sf_dir), "License", ordered=False), n, index.file_count, name)


MODES = ("License", "the", "[0-9]+", "theren", "zqxjkv")


def search_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return spark.createDataFrame([(p, *se.mode(index, p)) for p in MODES], "pattern string, mode string, candidates long")


def _mode_sql(pattern: str) -> str:
    plan = gp.plan_of(pattern)
    name = "'full-scan'" if plan == gp.FullScan() else "CASE WHEN n / greatest(total, 1) > 0.10 THEN 'rg-fullscan' ELSE 'indexed' END"
    return f"SELECT {quoted(pattern)} AS pattern, {name} AS mode, n AS candidates FROM (SELECT count(*) FILTER ({plan_sql(plan)}) AS n, count(*) AS total FROM documents)"


FILTERED = (("theren", "^src1/"), ("eaux", "^src"), ("License", None), ("the", "/en/"))


def search_mode_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and candidates of searches with a path filter; and whether the search itself read candidates only."""
    index = indexed(spark, sf_dir)
    choices = [(p, f, se.chosen(index, p, path_filter=f)) for p, f in FILTERED]
    return spark.createDataFrame([(p, f or "", c.mode, c.candidates, c.files is not None) for p, f, c in choices], "pattern string, path_filter string, mode string, candidates long, pruned boolean")


def _filtered_sql() -> str:
    one = "SELECT {p} AS pattern, {f} AS path_filter, CASE WHEN n / greatest(total, 1) > 0.10 THEN 'rg-fullscan' ELSE 'indexed' END AS mode, n AS candidates, n / greatest(total, 1) <= 0.10 AS pruned FROM (SELECT count(*) FILTER ({plan} AND regexp_matches({path}, {f})) AS n, count(*) AS total FROM documents)"
    return " UNION ALL ".join(one.format(p=quoted(p), f=quoted(f or ""), plan=plan_sql(gp.plan_of(p)), path=PATH) for p, f in FILTERED)


# ---- what is skipped, ignored, refused


def index_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a build in which some texts are binary, some too large and some unreadable."""
    c = co.documents_corpus(spark, sf_dir)
    broken = F.when(F.col("file_id") % 13 == 0, F.lit(None).cast("string")).when(F.col("file_id") % 7 == 0, F.concat(F.lit("a\0"), "text")).otherwise(F.col("text"))
    m = _once(spark, f"skips {sf_dir}", lambda path: ix.build(c.withColumn("text", broken), path, LIMIT)).meta
    return spark.createDataFrame([(m["file_count"], m["skipped_binary"], m["skipped_large"], m["skipped_errors"])], "file_count long, skipped_binary long, skipped_large long, skipped_errors long")


def _once(spark: SparkSession, name: str, make: Callable[[str], ix.Index]) -> ix.Index:
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        if not _built:
            atexit.register(_sweep)
        _built[key] = make(storage.scratch(spark))
    return _built[key]


def file_state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that an index keeps of its files."""
    return indexed(spark, sf_dir).states.select("path", "size", "status")


#: Path, whether it is a folder; ignore files as (folder, rows).
IGNORED_PATHS = (("a/x.log", False), ("a/keep.log", False), ("b/x.log", False), ("tmp", True), ("tmp", False), ("b/tmp", True), ("doc/a.txt", False), ("doc/sub/a.txt", False), ("b/only", False), ("c/only", False), ("q/f1.c", False), ("q/f22.c", False))
IGNORE_ROWS = (("", ["*.log", "!keep.log", "tmp/", "/doc/*.txt", "# *.c", "f?.c"]), ("b", ["only", "!x.log"]))


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = co.IgnoreRules()
    for folder, rows in IGNORE_ROWS:
        rules.add(rows, f"/r/{folder}".rstrip("/"))
    return spark.createDataFrame([(p, d, rules.ignored(f"/r/{p}", d)) for p, d in IGNORED_PATHS], "path string, folder boolean, ignored boolean")


PATTERNS = {"a(?=b)": False, "(a)\\1": False, "a++": False, "(?>a)": False, "a{2": False, "(a": False, "[a": False, "a{3,2}": False, "(?P<n>a)b": True, "[[:alpha:]]+x": True, "\\bfoo\\b": True, "a|b*?": True, "\\x41\\p{L}": True}


def pattern_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns outside the linear-time dialect are errors."""
    from gramlode.plans.regex import PatternError, parse

    def valid(p: str) -> bool:
        try:
            parse(p)
        except PatternError:
            return False
        return True

    return spark.createDataFrame([(p, valid(p)) for p in PATTERNS], "pattern string, valid boolean")


FLAGS = ((0, None, None), (5, None, 1), (5, 2, None), (3, 0, 0), (0, 4, None))


def context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.cli import context_lines

    return spark.createDataFrame([(i, *context_lines(*f)) for i, f in enumerate(FLAGS)], "case int, before int, after int")


#: Contents with lines that are not UTF-8, in hex.
BROKEN = ("6f6b206c696e650a", "62616420ff206c696e650a676f6f64206c696e65", "e28c0a6c696e652032", "6c696e6520310d0a6c696e65fe0a6c696e652033")


def lossy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not UTF-8 count in the numbering and never match."""
    rows = [(i, f"f{i}", 1, 1, *co.decoded(bytes.fromhex(h))) for i, h in enumerate(BROKEN)]
    return se.scan(spark.createDataFrame(rows, co.SCHEMA), "line").select("path", "line_number", "line_text")


EXPLAINED = ("hello", "foo.*bar", "foo|bar", "(foo)(bar)", "(foo|bar)baz", "[abc]def", "fn", "foo|[a-z]")


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, gp.explain(gp.plan_of(p))) for p in EXPLAINED], "pattern string, plan string")


def _explained_sql() -> str:
    """The plans as worked out by hand; only the hashes are computed."""
    look = lambda g, pad="": f"'{pad}lookup \"{g}\" → 0x' || (SELECT hash FROM h WHERE gram = '{g}')"
    tree = lambda name, *gs: f"'{name}(' || chr(10) || " + " || chr(10) || ".join(look(g, "  ") for g in gs) + " || chr(10) || ')'"
    nested = "'AND(' || chr(10) || '  OR(' || chr(10) || " + look("foo", "    ") + " || chr(10) || " + look("bar", "    ") + " || chr(10) || '  )' || chr(10) || " + look("baz", "  ") + " || chr(10) || ')'"
    plans = {"hello": tree("AND", "hel", "ell", "llo"), "foo.*bar": tree("AND", "foo", "bar"), "foo|bar": tree("OR", "foo", "bar"), "(foo)(bar)": tree("AND", "foo", "bar"), "(foo|bar)baz": nested, "[abc]def": look("def"), "fn": "'FULL_SCAN'", "foo|[a-z]": "'FULL_SCAN'"}
    hashes = " UNION ALL ".join(f"SELECT '{g}' AS gram, {hash_sql(g)} AS hash" for g in ("hel", "ell", "llo", "foo", "bar", "baz", "def"))
    return f"WITH h AS ({hashes}) " + " UNION ALL ".join(f"SELECT {quoted(p)} AS pattern, {x} AS plan" for p, x in plans.items())


def hash_sql(gram: str) -> str:
    state = "14695981039346656037::uhugeint"
    for b in gram.encode():
        state = f"((xor({state}, {b}::uhugeint) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
    return f"lpad(lower(hex(({state})::ubigint)), 16, '0')"


# ---- freshness: two snapshots of the documents


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Old: without every seventh document. New: without every eleventh; every fifth has another text and time."""
    c = co.documents_corpus(spark, sf_dir)
    touched = F.col("file_id") % 5 == 0
    if new:
        text = F.when(touched, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
        return c.filter("file_id % 11 != 0").withColumn("text", text).withColumn("size", F.octet_length("text").cast("long")).withColumn("mtime_ns", F.when(touched, F.lit(2)).otherwise(F.lit(1)).cast("long"))
    return c.filter("file_id % 7 != 0").withColumn("mtime_ns", F.lit(1).cast("long"))


DIFF_SQL = f"""WITH {FILES}, o AS (SELECT path, size, 1 AS m FROM files WHERE file_id % 7 <> 0),
n AS (SELECT path, CASE WHEN file_id % 5 = 0 THEN size + 7 ELSE size END AS size, CASE WHEN file_id % 5 = 0 THEN 2 ELSE 1 END AS m FROM files WHERE file_id % 11 <> 0),
d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.m <> n.m OR o.size <> n.size THEN 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path)
"""


def freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.diff(snapshot(spark, sf_dir, False), snapshot(spark, sf_dir, True)).orderBy("path")


def freshness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.summary(freshness_diff(spark, sf_dir), snapshot(spark, sf_dir, False))


def _incremental(spark: SparkSession, sf_dir: str) -> ix.Index:
    """Once in a session; deleted at its end like the other."""
    key = (spark.sparkContext.applicationId, f"incremental {sf_dir}")
    if key not in _built:
        old = ix.build(snapshot(spark, sf_dir, False), storage.scratch(spark))
        if not _built:
            atexit.register(_sweep)
        _built[key] = freshness.refresh(old, snapshot(spark, sf_dir, True))[0]
    return _built[key]


def incremental_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = [gp.gram_key(g) for g in (b"the", b"edi", b"eau")]
    return _incremental(spark, sf_dir).rows_of(grams)


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that differ from those of a full build: none."""
    new = _incremental(spark, sf_dir).postings.select("gram", "file_id")
    full = ix.postings_of(snapshot(spark, sf_dir, True))
    return new.exceptAll(full).unionAll(full.exceptAll(new))


SIZES = (0, 1023, 1024, 1536, 1048575, 1048576, 10485760, 5368709120)


def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in SIZES], "n long").select("n", tx.format_size_column(F.col("n")).alias("shown"))


def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, tx.parse_size(s)) for s in ("10M", "500k", "1G", "77")], "text string, n long")


CORPORA = {
    "search_pages": (pages_corpus, "casino|track\\([0-9]\\)", "files AS (SELECT url AS path, coalesce(html, '') AS text FROM pages)"),
    "search_conversations": (conversations_corpus, "the.*and", "files AS (SELECT concat(conv_id::varchar, '/', lpad(turn::varchar, 4, '0'), '/', role) AS path, coalesce(text, '') AS text FROM conversations)"),
    "search_parts": (parts_corpus, "^[a-z]+ [a-z]*e", "files AS (SELECT concat(p_brand, '/', lpad(p_partkey::varchar, 9, '0')) AS path, coalesce(p_name, '') AS text FROM part)"),
}


def _corpus_search(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make, pattern, _ = CORPORA[name]
    return flat(se.scan(make(spark, sf_dir), pattern))


_PLAIN = (corpus_files, file_ids, index_eligible, gram_extract, index_stats, index_build_stats, gram_df_topk, posting_lists, posting_gaps, posting_decode, posting_bytes, gram_hash, search_no_index, indexed_equals_scan, search_json, search_text, search_highlight, search_summary, search_mode, search_mode_filtered, index_skips, file_state_read, ignored_paths, pattern_valid, context_flags, lossy_lines, explain_plan, freshness_diff, freshness_summary, incremental_postings, incremental_equals_full, size_format, size_parse)


def _values(columns: str, rows) -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::int"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in _PLAIN}
    found |= {n: partial(_candidates, name=n) for n in PLANS}
    found |= {n: partial(_search, name=n) for n in SEARCHES}
    found |= {n: partial(_corpus_search, name=n) for n in CORPORA}
    return found


JSON_TEXT = "replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')"
_CONTEXT = "ls[greatest(n - 1, 1):n - 1] AS b, ls[n + 1:n + 1] AS a"


def oracle_sql() -> dict[str, str]:
    esc = JSON_TEXT.format
    jlist = lambda c: f"'[' || coalesce(array_to_string(list_transform({c}, lambda x: '\"' || {esc('x')} || '\"'), ','), '') || ']'"
    hits = f"WITH {lines_sql()} SELECT path, n::int AS line_number"
    found = {n: _search_sql(n) for n in SEARCHES}
    found |= {n: f"WITH {FILES} SELECT file_id, path FROM files WHERE {plan_sql(p)}" for n, p in PLANS.items()}
    found |= {n: search_sql(p, files=f) for n, (_, p, f) in CORPORA.items()}
    edited = f"{FILES}, n AS (SELECT file_id, translate(CASE WHEN file_id % 5 = 0 THEN text || ' edited' ELSE text END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM files WHERE file_id % 11 <> 0)"
    nothing = "SELECT ''::varchar AS path, 0::int AS line_number WHERE false"
    found |= {
        "corpus_files": f"WITH {FILES} SELECT file_id, path, size::bigint AS size FROM files",
        "file_ids": f"WITH {FILES} SELECT path, row_number() OVER (ORDER BY encode(path)) - 1 AS file_id FROM files",
        "index_eligible": f"WITH {FILES} SELECT CASE WHEN size > {LIMIT} THEN 'skipped_large' WHEN contains(text, chr(0)) THEN 'skipped_binary' ELSE 'indexed' END AS status, count(*) AS n FROM files GROUP BY 1",
        "gram_extract": f"WITH {GRAMS_SQL} SELECT gram, file_id FROM postings",
        "index_stats": f"WITH {GRAMS_SQL} SELECT count(DISTINCT file_id) AS file_count, count(DISTINCT gram) AS ngram_count, count(*) AS total_ngrams FROM postings",
        "index_build_stats": f"WITH hexed AS (SELECT hex(encode({LOWER})) AS h FROM (SELECT coalesce(text, '') AS text FROM documents)), lists AS (SELECT list_distinct(list_transform(range(0, greatest(length(h) // 2 - 2, 0)), lambda i: substr(h, 2 * i + 1, 6))) AS gs FROM hexed) SELECT (SELECT count(*) FROM lists) AS file_count, (SELECT count(DISTINCT g) FROM (SELECT unnest(gs) AS g FROM lists)) AS ngram_count, (SELECT sum(len(gs))::bigint FROM lists) AS total_ngrams, 0::bigint AS skipped_binary, 0::bigint AS skipped_large",
        "gram_df_topk": f"WITH {GRAMS_SQL} SELECT gram, count(*) AS df FROM postings GROUP BY gram ORDER BY df DESC, gram LIMIT 100",
        "posting_lists": f"WITH {GRAMS_SQL} SELECT gram, string_agg(file_id::varchar, ',' ORDER BY file_id) AS file_ids FROM postings GROUP BY gram",
        "posting_gaps": f"WITH {GRAMS_SQL} SELECT gram, file_id, file_id - coalesce(lag(file_id) OVER (PARTITION BY gram ORDER BY file_id), 0) AS gap FROM postings",
        "posting_decode": f"WITH {GRAMS_SQL} SELECT gram, file_id FROM postings",
        "posting_bytes": f"WITH {GRAMS_SQL}, g AS (SELECT gram, file_id - coalesce(lag(file_id) OVER (PARTITION BY gram ORDER BY file_id), 0) AS gap FROM postings) SELECT gram, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END)::bigint AS n_bytes FROM g GROUP BY gram",
        "gram_hash": " UNION ALL ".join(f"SELECT {quoted(g)} AS gram, {hash_sql(g)} AS hash" for g in ("abc", "def", "fn ", "")),
        "search_no_index": search_sql("that.*the"),
        "indexed_equals_scan": nothing,
        "search_json": f"WITH {lines_sql()}, m AS (SELECT path, n::int AS line_number, line_text, {_CONTEXT} FROM lines WHERE regexp_matches(line_text, 'License')) SELECT path, line_number, '{{\"type\":\"match\",\"path\":\"' || path || '\",\"line_number\":' || line_number || ',\"line_text\":\"' || {esc('line_text')} || '\",\"context_before\":' || {jlist('b')} || ',\"context_after\":' || {jlist('a')} || '}}' AS json FROM m",
        "search_text": f"WITH {lines_sql()}, m AS (SELECT path, n::int AS line_number, line_text, {_CONTEXT} FROM lines WHERE regexp_matches(line_text, 'License')) SELECT path, line_number, array_to_string(list_concat(list_concat(list_transform(b, lambda x: path || '-' || (line_number - 1) || '-' || x), [path || ':' || line_number || ':' || line_text]), list_transform(a, lambda x: path || '-' || (line_number + 1) || '-' || x)), chr(10)) AS text FROM m",
        "search_highlight": f"{hits}, regexp_replace(line_text, '(Lic[a-z]+)', chr(27) || '[1;31m' || chr(92) || '1' || chr(27) || '[0m', 'g') AS text FROM lines WHERE regexp_matches(line_text, 'Lic[a-z]+')",
        "search_summary": f"WITH {lines_sql()}, m AS (SELECT count(*) AS match_count, count(DISTINCT path) AS file_count FROM lines WHERE regexp_matches(line_text, 'License')), c AS ({_mode_sql('License')}) SELECT match_count, file_count, candidates AS files_searched, (SELECT count(*) FROM documents) AS total_files, mode FROM m, c",
        "search_mode": " UNION ALL ".join(map(_mode_sql, MODES)),
        "search_mode_filtered": _filtered_sql(),
        "index_skips": f"WITH {FILES} SELECT count(*) FILTER (s = 'i') AS file_count, count(*) FILTER (s = 'b') AS skipped_binary, count(*) FILTER (s = 'l') AS skipped_large, count(*) FILTER (s = 'e') AS skipped_errors FROM (SELECT CASE WHEN file_id % 13 = 0 THEN 'e' WHEN size > {LIMIT} THEN 'l' WHEN file_id % 7 = 0 THEN 'b' ELSE 'i' END AS s FROM files)",
        "file_state_read": f"WITH {FILES} SELECT path, size::bigint AS size, 'indexed' AS status FROM files",
        "ignored_paths": _values("path, folder, ignored", [(p, d, (p, d) in {("a/x.log", False), ("tmp", True), ("b/tmp", True), ("doc/a.txt", False), ("b/only", False), ("q/f1.c", False)}) for p, d in IGNORED_PATHS]),
        "pattern_valid": _values("pattern, valid", PATTERNS.items()),
        "context_flags": _values('"case", before, after', [(0, 0, 0), (1, 5, 1), (2, 2, 5), (3, 0, 0), (4, 4, 0)]),
        "lossy_lines": _values("path, line_number, line_text", [("f0", 1, "ok line"), ("f1", 2, "good line"), ("f2", 2, "line 2"), ("f3", 1, "line 1"), ("f3", 3, "line 3")]),
        "explain_plan": _explained_sql(),
        "freshness_diff": DIFF_SQL + "SELECT path, change FROM d WHERE change IS NOT NULL",
        "freshness_summary": DIFF_SQL + "SELECT count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(change) = 0 AS is_fresh, (SELECT count(*) FROM o) AS total_indexed FROM d",
        "incremental_postings": f"WITH {edited} " + " UNION ALL ".join(f"SELECT {gp.gram_key(g.encode())} AS gram, file_id FROM n WHERE contains(t, '{g}')" for g in ("the", "edi", "eau")),
        "incremental_equals_full": "SELECT 0::int AS gram, 0::bigint AS file_id WHERE false",
        "size_format": "SELECT n, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || 'KB' ELSE printf('%.1f', n / 1048576.0) || 'MB' END AS shown FROM (SELECT unnest([" + ", ".join(f"{n}::bigint" for n in SIZES) + "]) AS n)",
        "size_parse": "SELECT '10M' AS text, 10485760::bigint AS n UNION ALL SELECT '500k', 512000 UNION ALL SELECT '1G', 1073741824 UNION ALL SELECT '77', 77",
    }
    return found
