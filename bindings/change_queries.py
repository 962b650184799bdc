"""Commit logs, file lists, diffs, snapshots and ownership over derived texts.

Every text is built from one row and parsed back, so building it needs no grouping.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import hashing, paths
from revlens.operators import features, ownership
from revlens.plans import report
from revlens.schemas import TARGET
from revlens.sources import files as file_sources
from revlens.session import spread
from revlens.sources import git_text

from .inputs import table, with_target
from .text_queries import PLACES

US, NL, TAB = "\x1f", "\n", "\t"


def text_of(*parts):
    """Concatenation of column names in angle brackets and plain text."""
    columns = [
        F.col(part[1:-1]).cast("string") if part.startswith("<") and part.endswith(">") else F.lit(part)
        for part in parts
    ]
    return F.concat(*columns)


def orders(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "orders")).withColumns({
        "k": F.col("o_orderkey"), "c": F.col("o_custkey"),
        "a": F.col("o_orderkey") % 50 + 1, "b": F.col("o_orderkey") % 60 + 1,
        "sha": F.sha2(F.col("o_orderkey").cast("string"), 256),
        "epoch": F.unix_timestamp(F.col("o_orderdate").cast("timestamp")),
    })
    return with_target(rows, F.col("o_orderkey"))


def commit_log(spark, sf_dir):
    mark = git_text.COMMIT_MARKER
    text = text_of(
        mark, NL, "<sha>", US, "<epoch>", US, "<o_orderpriority>", NL, NL, "  body ", "<c>", " ", NL, NL,
        "<c>", TAB, "<a>", TAB, "src/a.py", NL, "-", TAB, "-", TAB, "img.png", NL,
        mark, NL, "<sha>", "b", US, "<epoch>", US, "<o_orderstatus>", NL, NL,
        "<b>", TAB, "0", TAB, "b", TAB.strip(), ".py", NL,
    )
    return git_text.commit_log(orders(spark, sf_dir).select(*TARGET, text.alias("text"))).drop("snapshot_id", "head_sha")


def newest_commits(spark, sf_dir):
    commits = orders(spark, sf_dir).select(
        F.col("c").cast("string").alias("repository_id"), F.col("sha").alias("commit_sha"),
        F.col("epoch").alias("timestamp"),
    )
    return git_text.newest_commits(commits, 3)


def commit_medians(spark, sf_dir):
    rows = report.exact_medians(commit_log(spark, sf_dir), ("files_changed",), {"additions": "median_additions", "deletions": "median_deletions"})
    return rows.select("files_changed", F.col("n").alias("commits_analyzed"), *[F.round(name, PLACES).alias(name) for name in ("median_additions", "median_deletions")])


def change_texts(spark, sf_dir):
    rows = orders(spark, sf_dir)
    status = text_of(
        "M", TAB, "src/m", "<c>", ".py", NL, "A", TAB, "tests/test_", "<a>", ".py", NL,
        "R100", TAB, "old/x.md", TAB, "docs/", "<b>", ".md", NL, "D", TAB, "logo.png", NL, "X", TAB, "odd", NL,
    )
    counts = text_of(
        "<c>", TAB, "<a>", TAB, "src/m", "<c>", ".py", NL, "3", TAB, "0", TAB, "tests/test_", "<a>", ".py", NL,
        "-", TAB, "-", TAB, "logo.png", NL,
    )
    diff = text_of(
        "diff --git a/src/m", "<c>", ".py b/src/m", "<c>", ".py", NL, "--- a/src/m", "<c>", ".py", NL,
        "+++ b/src/m", "<c>", ".py", NL, "@@ -", "<a>", " +", "<b>", ",2 @@ def f", "<c>", "():", NL,
        "-old ", "<k>", NL, "+new ", "<k>", NL, "+++ plus ", "<k>", NL,
        "diff --git a/gone.py b/gone.py", NL, "deleted file mode 100644", NL, "--- a/gone.py", NL,
        "+++ /dev/null", NL, "@@ -1,", "<a>", " +0,0 @@", NL, "-line", NL, "-- dash ", "<k>", NL,
    )
    untracked = rows.filter(F.col("o_orderstatus") == "P").select(
        *TARGET, text_of("new/", "<k>", ".txt").alias("path"), text_of("<o_orderpriority>", NL, "x", NL).alias("code")
    )
    pick = lambda column: rows.select(*TARGET, column.alias("text"))
    return pick(status), pick(counts), pick(diff), untracked


def changed_file_rows(spark, sf_dir):
    status, counts, _, untracked = change_texts(spark, sf_dir)
    return git_text.changed_files(git_text.name_status(status), git_text.numstat(counts), untracked)


def changed_files(spark, sf_dir):
    return changed_file_rows(spark, sf_dir).drop("snapshot_id", "head_sha")


def changed_hunk_rows(spark, sf_dir):
    return git_text.changed_hunks(change_texts(spark, sf_dir)[2])


def changed_hunks(spark, sf_dir):
    return changed_hunk_rows(spark, sf_dir).drop("snapshot_id", "head_sha").withColumns({
        "added_lines": F.array_join("added_lines", "|"), "removed_lines": F.array_join("removed_lines", "|"),
    })


def packed_changes(spark, sf_dir):
    """Changed files and hunks under one digest of their keys, and what they are keyed by."""
    status, counts, diff, untracked = [hashing.pack(texts, TARGET) for texts in change_texts(spark, sf_dir)]
    keys = [hashing.PACKED]
    files = git_text.changed_files(git_text.name_status(status, keys), git_text.numstat(counts, keys), untracked, keys)
    return files, git_text.changed_hunks(diff, keys), keys


def change_features(spark, sf_dir):
    packed = features.change_features(*packed_changes(spark, sf_dir))
    wide = hashing.unpack(packed, orders(spark, sf_dir), TARGET)
    long = features.aggregate_feature_values(wide, "change")
    return long.select("repository_id", "name", F.round("value", PLACES).alias("value"), "family", "reliability")


def change_contexts(spark, sf_dir):
    targets = orders(spark, sf_dir).select(
        *TARGET, F.when(F.col("o_orderstatus") != "O", F.col("sha")).alias("base_sha"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("intent"),
        F.lit("main").alias("branch"), (F.col("o_orderstatus") == "P").alias("dirty"),
    )
    packed = git_text.change_contexts(hashing.pack(targets, TARGET), *packed_changes(spark, sf_dir))
    frame = hashing.unpack(packed, targets, TARGET)
    return frame.select(
        "repository_id", "branch", "dirty", "changed_files", "changed_hunks", "context_completeness",
        F.array_join("missing_context", ",").alias("missing_context"),
    )


def snapshots(spark, sf_dir):
    """Working trees of all orders; their line items are the untracked files."""
    states = orders(spark, sf_dir).select(
        F.col("k"), text_of("https://host/", "<c>").alias("remote"), "head_sha", F.sha1("o_orderpriority").alias("tree_hash"),
        F.encode(text_of("diff ", "<o_totalprice>"), "UTF-8").alias("diff"), (F.col("o_orderstatus") != "F").alias("dirty"),
    )
    # A path has all that a file is made of but its order, so distinct numbers are distinct files.
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    untracked = lineitem.select(
        F.col("l_orderkey").alias("k"),
        F.concat_ws("/", F.lit("u"), "l_linenumber", "l_partkey", "l_suppkey").alias("path"),
        F.encode(F.concat(F.lit("part "), "l_partkey"), "UTF-8").alias("content"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("to/"), "l_suppkey")).alias("link"),
    )
    hashes = git_text.diff_hashes(states, untracked, ["k"])
    return git_text.snapshots(states, hashes, ["k"])


def working_tree_samples(spark, sf_dir):
    """Documents and pages as files of mixed types and sizes."""
    documents = table(spark, sf_dir, "documents")
    endings = F.array(*map(F.lit, (".py", ".JS", ".tsx", ".rs", ".txt", ".md", "")))
    ending = F.element_at(endings, (F.col("doc_id") % 7 + 1).cast("int"))
    files = with_target(documents, F.col("source")).select(
        *TARGET, F.concat(F.col("lang"), F.lit("/f"), F.col("doc_id"), ending).alias("path"),
        F.octet_length("text").cast("long").alias("length"), F.col("text").alias("code"),
    )
    samples = file_sources.code_samples(files, max_bytes=250_000)
    return samples.select("sample_id", "repository_id", "language", "path", F.sha2("code", 256).alias("digest"))


OWNER_TEXT = NL.join([
    "*.md @docs/writers docs@example.com", "/fr/ @fr 'quoted'@example.com", "en/*5.py @five @five",
    "**/7?.md @seven", "!neg @x", "lonely", "bad notowner", "# comment", 'open "quote', "de/**/1* @deep  # trailing",
    "tail\\", "es @es-name bad", "/en/6[0-9].md @x",
])


def changed_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    inner = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    keyed = with_target(pages, host)
    return keyed.select(
        *TARGET, "page_id",
        F.concat(inner, F.when(F.col("page_id") % 3 == 0, ".py").otherwise(".md")).alias("path"),
    )


def owner_files(spark, sf_dir):
    """Two locations per host, the second for hosts of even name length only; text depends on the host."""
    hosts = changed_pages(spark, sf_dir).select(*TARGET).distinct()
    first = hosts.select(
        *TARGET, F.lit("docs/CODEOWNERS").alias("path"), F.lit("* @never-used").alias("code")
    )
    second = hosts.filter(F.length("repository_id") % 2 == 0).select(
        *TARGET, F.lit("CODEOWNERS").alias("path"),
        F.concat(F.when(F.length("repository_id") % 4 == 0, "* @everyone\n").otherwise("\n"), F.lit(OWNER_TEXT)).alias("code"),
    )
    return first.unionByName(second)


def parsed_owners(spark, sf_dir):
    return ownership.parse_rules(ownership.ownership_files(owner_files(spark, sf_dir)))


def owner_text(column="owners"):
    return F.array_join(F.transform(column, lambda o: F.concat_ws(":", o["kind"], o["identifier"])), ",")


def owner_rules(spark, sf_dir):
    rules = ownership.owner_rules(parsed_owners(spark, sf_dir))
    return rules.select("repository_id", "source_path", "line", "pattern", owner_text().alias("owners"))


def owner_issues(spark, sf_dir):
    return ownership.owner_issues(parsed_owners(spark, sf_dir)).select("repository_id", "line", "kind", "detail")


def path_owners(spark, sf_dir):
    pages = changed_pages(spark, sf_dir)
    owned = ownership.path_owners(pages.select(*TARGET, "path").distinct(), parsed_owners(spark, sf_dir))
    return owned.select("repository_id", "path", owner_text().alias("owners"), F.coalesce("line", F.lit(0)).alias("line"))


def unowned_paths(spark, sf_dir):
    pages = changed_pages(spark, sf_dir)
    owned = ownership.path_owners(pages.select(*TARGET, "path").distinct(), parsed_owners(spark, sf_dir))
    return ownership.unowned_paths(owned).select("repository_id", "path")


def symbol_owners(spark, sf_dir):
    pages = changed_pages(spark, sf_dir)
    owned = ownership.path_owners(pages.select(*TARGET, "path").distinct(), parsed_owners(spark, sf_dir))
    symbols = pages.filter(F.col("path").endswith(".py")).withColumn("symbol_id", F.col("page_id").cast("string"))
    rows = ownership.symbol_owners(symbols, owned)
    return rows.select("symbol_id", "path", owner_text().alias("owners"), F.array_join("evidence_refs", ",").alias("refs"))


def ownership_contexts(spark, sf_dir):
    pages = changed_pages(spark, sf_dir).select(*TARGET, "path").distinct()
    parsed = parsed_owners(spark, sf_dir)
    frame = ownership.ownership_contexts(
        pages.select(*TARGET).distinct(), parsed, ownership.path_owners(pages, parsed)
    )
    return frame.drop("snapshot_id", "head_sha")


def declared_owners(spark, sf_dir):
    return ownership.declared_owners(parsed_owners(spark, sf_dir)).select("repository_id", "identifier", "kind")


def name_projections(spark, sf_dir):
    """Path, module, slug and metric-name projections over part names."""
    part = table(spark, sf_dir, "part")
    path = F.concat(
        F.when(F.col("p_size") % 2 == 0, "src/").otherwise("lib/"), F.regexp_replace("p_name", " ", "_"), F.lit("/"),
        F.when(F.col("p_size") % 5 == 0, "__init__").otherwise(F.concat(F.lit("test_"), "p_size")), F.lit(".py"),
    )
    named = part.select("p_partkey", "p_name", "p_brand", "p_size", path.alias("path"))
    module = paths.module_name(F.col("path"), True)
    return named.select(
        "p_partkey", "path", module.alias("stripped_module"),
        paths.module_name(F.col("path"), False).alias("plain_module"),
        paths.import_base(module, paths.is_package_init(F.col("path")), F.col("p_size") % 4, F.lit("x.y")).alias("base"),
        paths.is_test_path(F.col("path")).alias("is_test"), paths.is_architecture_path(F.col("path")).alias("analysed"),
        paths.slug(F.concat(F.lit("#"), "p_brand", F.lit(" "), "p_name")).alias("slug"),
        paths.metric_key(F.concat("p_brand", F.lit("!"))).alias("metric"),
        paths.escapes_root(F.concat(F.lit("a/../"), F.when(F.col("p_size") > 40, "../").otherwise(""), "path")).alias("escapes"),
        paths.is_public_name(F.concat(F.lit("A."), F.when(F.col("p_size") < 5, "_").otherwise(""), "p_name")).alias("public"),
        F.array_join(F.array_sort(paths.relevance_tokens(F.concat_ws(" ", "p_name", "path"))), ",").alias("tokens"),
    )


QUERIES = {
    "commit_log": commit_log,
    "newest_commits": newest_commits,
    "commit_medians": commit_medians,
    "changed_files": changed_files,
    "changed_hunks": changed_hunks,
    "change_features": change_features,
    "change_contexts": change_contexts,
    "snapshots": snapshots,
    "working_tree_samples": working_tree_samples,
    "owner_rules": owner_rules,
    "owner_issues": owner_issues,
    "path_owners": path_owners,
    "unowned_paths": unowned_paths,
    "symbol_owners": symbol_owners,
    "ownership_contexts": ownership_contexts,
    "declared_owners": declared_owners,
    "name_projections": name_projections,
}

ORDERS_SQL = """(SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey % 50 + 1 AS a, o_orderkey % 60 + 1 AS b,
  sha256(o_orderkey::VARCHAR) AS sha, epoch(o_orderdate)::BIGINT AS epoch, o_orderkey::VARCHAR AS repository_id FROM orders)"""
COMMITS_SQL = f"""
SELECT repository_id, sha AS commit_sha, epoch AS "timestamp", o_orderpriority || chr(10) || 'body ' || c AS commit_message,
  2::BIGINT AS files_changed, c AS additions, a AS deletions FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, sha || 'b', epoch, o_orderstatus, 1, b, 0 FROM {ORDERS_SQL}"""
FILES_SQL = f"""
SELECT repository_id, 'src/m' || c || '.py' AS path, 'modified' AS status, c AS additions, a AS deletions, false AS "binary" FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'tests/test_' || a || '.py', 'added', 3, 0, false FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'docs/' || b || '.md', 'renamed', 0, 0, false FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'logo.png', 'deleted', 0, 0, true FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'odd', 'unknown', 0, 0, false FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'new/' || k || '.txt', 'added', 2, 0, false FROM {ORDERS_SQL} WHERE o_orderstatus = 'P'"""

_host = "regexp_extract(url, '^https?://([^/]+)', 1)"
PAGES_SQL = f"""SELECT page_id, {_host} AS repository_id,
  regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '.py' ELSE '.md' END AS path FROM pages"""
_rule_owners = {
    2: ("*.md", "team:@docs/writers,email:docs@example.com"), 3: ("/fr/", "user:@fr,email:quoted@example.com"),
    4: ("en/*5.py", "user:@five"), 5: ("**/7?.md", "user:@seven"), 11: ("de/**/1*", "user:@deep"), 13: ("es", "user:@es-name"),
}
_rule_rows = ", ".join(f"({line}, '{pattern}', '{owners}')" for line, (pattern, owners) in _rule_owners.items())
RULES_SQL = f"""
WITH h AS (SELECT DISTINCT repository_id FROM ({PAGES_SQL})), r(line, pattern, owners) AS (VALUES {_rule_rows})
SELECT repository_id, 'CODEOWNERS' AS source_path, line::BIGINT AS line, pattern, owners FROM h CROSS JOIN r WHERE length(repository_id) % 2 = 0
UNION ALL SELECT repository_id, 'CODEOWNERS', 1, '*', 'user:@everyone' FROM h WHERE length(repository_id) % 4 = 0
UNION ALL SELECT repository_id, 'docs/CODEOWNERS', 1, '*', 'user:@never-used' FROM h WHERE length(repository_id) % 2 = 1"""
_issue_rows = ", ".join(
    f"({line}, '{kind}', '{detail}')" for line, kind, detail in (
        (6, "unsupported_pattern", ownership.UNSUPPORTED), (7, "malformed_rule", ownership.NO_OWNERS),
        (8, "invalid_owner", "notowner"), (8, "malformed_rule", ownership.NO_VALID_OWNERS),
        (10, "malformed_rule", ownership.OPEN_QUOTE), (12, "malformed_rule", ownership.OPEN_ESCAPE),
        (13, "invalid_owner", "bad"), (14, "unsupported_pattern", ownership.UNSUPPORTED),
    )
)
OWNED_SQL = f"""
WITH p AS (SELECT DISTINCT repository_id, path FROM ({PAGES_SQL})),
m AS (SELECT *, CASE WHEN length(repository_id) % 2 = 1 THEN 1
  WHEN regexp_matches(path, '^(?:.*/)?es$') THEN 13 WHEN regexp_matches(path, '^de/(?:.*/)?1[^/]*$') THEN 11
  WHEN regexp_matches(path, '^(?:.*/)?7[^/]\\.md$') THEN 5 WHEN regexp_matches(path, '^en/[^/]*5\\.py$') THEN 4
  WHEN starts_with(path, 'fr/') THEN 3 WHEN ends_with(path, '.md') THEN 2
  WHEN length(repository_id) % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS line FROM p)
SELECT m.repository_id, path, coalesce(owners, '') AS owners, m.line, source_path
FROM m LEFT JOIN ({RULES_SQL}) r ON r.repository_id = m.repository_id AND r.line = m.line"""

_stem = r"regexp_replace(path, '\.py$', '')"
_module = rf"replace(regexp_replace(regexp_replace({_stem}, '^src/', ''), '/__init__$', ''), '/', '.')"

ORACLES = {
    "commit_log": COMMITS_SQL,
    "newest_commits": f"""
SELECT repository_id, commit_sha, "timestamp" FROM (
  SELECT c::VARCHAR AS repository_id, sha AS commit_sha, epoch AS "timestamp",
    row_number() OVER (PARTITION BY c ORDER BY epoch DESC, sha) AS n FROM {ORDERS_SQL}) WHERE n <= 3""",
    "commit_medians": f"""
SELECT files_changed::BIGINT AS files_changed, count(*) AS commits_analyzed, round(median(additions), {PLACES})::DOUBLE AS median_additions,
  round(median(deletions), {PLACES})::DOUBLE AS median_deletions FROM ({COMMITS_SQL}) GROUP BY files_changed""",
    "changed_files": FILES_SQL,
    "changed_hunks": f"""
SELECT repository_id, 'src/m' || c || '.py' AS path, a AS old_start, 1::BIGINT AS old_lines, b AS new_start, 2::BIGINT AS new_lines,
  'def f' || c || '():' AS header, 'new ' || k || '|++ plus ' || k AS added_lines, 'old ' || k AS removed_lines FROM {ORDERS_SQL}
UNION ALL SELECT repository_id, 'gone.py', 1, a, 0, 0, '', '', 'line|- dash ' || k FROM {ORDERS_SQL}""",
    "change_features": f"""
WITH f AS (SELECT repository_id, count(*) AS n, sum(additions) AS a, sum(deletions) AS d,
  count(DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END) AS s FROM ({FILES_SQL}) GROUP BY ALL),
v AS (SELECT repository_id, unnest([('change_files', n), ('change_hunks', 2), ('change_additions', a), ('change_deletions', d),
  ('change_churn', a + d), ('change_subsystems', s), ('change_test_file_ratio', round(1.0 / n, {PLACES})), ('change_binary_files', 1)]) AS x FROM f)
SELECT repository_id, x[1] AS name, x[2]::DOUBLE AS value, 'change_structure' AS family, 'high' AS reliability FROM v""",
    "change_contexts": f"""
SELECT repository_id, 'main' AS branch, o_orderstatus = 'P' AS dirty, CASE WHEN o_orderstatus = 'P' THEN 6 ELSE 5 END::BIGINT AS changed_files,
  2::BIGINT AS changed_hunks, (2 - (o_orderstatus = 'O')::INT - (o_orderpriority = '5-LOW')::INT) / 2.0::DOUBLE AS context_completeness,
  concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'base_sha' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'intent' END) AS missing_context
FROM {ORDERS_SQL}""",
    "snapshots": f"""
WITH u AS (SELECT DISTINCT l_orderkey AS k, 'u/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, l_partkey, l_suppkey, l_linenumber FROM lineitem),
g AS (SELECT k, sha256(path)[:3] AS r, sha256(unhex(string_agg('00' || hex('UNTRACKED') || '00' || hex(path) || '00' || CASE WHEN l_linenumber = 7
    THEN hex('SYMLINK') || '00' || hex('to/' || l_suppkey) ELSE hex('FILE') || '00' || upper(sha256('part ' || l_partkey)) END, '' ORDER BY path))) AS d FROM u GROUP BY k, r),
e AS (SELECT k, string_agg(r || ':' || d, '' ORDER BY r) AS tail FROM g GROUP BY k),
s AS (SELECT o.*, CASE WHEN o_orderstatus <> 'F' THEN sha256('diff ' || o_totalprice || coalesce(tail, '')) END AS diff_hash
  FROM {ORDERS_SQL} o LEFT JOIN e USING (k)),
i AS (SELECT k, sha256('https://host/' || c)[:16] AS repository_id, sha256(k::VARCHAR) AS head_sha, sha1(o_orderpriority) AS tree_hash, diff_hash, o_orderstatus <> 'F' AS dirty FROM s)
SELECT *, 'snap_' || sha256(concat_ws(chr(31), repository_id, head_sha, tree_hash, coalesce(diff_hash, 'clean')))[:24] AS snapshot_id FROM i""",
    "working_tree_samples": """
SELECT sha256(source || ':' || path)[:20] AS sample_id, source AS repository_id, language, path, sha256(text) AS digest
FROM (SELECT *, lang || '/f' || doc_id || ['.py', '.JS', '.tsx', '.rs', '.txt', '.md', ''][doc_id % 7 + 1] AS path,
  ['python', 'javascript', 'typescript', 'rust', NULL, NULL, NULL][doc_id % 7 + 1] AS language FROM documents)
WHERE language IS NOT NULL AND strlen(text) <= 250000""",
    "owner_rules": RULES_SQL,
    "owner_issues": f"""
WITH h AS (SELECT DISTINCT repository_id FROM ({PAGES_SQL})), i(line, kind, detail) AS (VALUES {_issue_rows})
SELECT repository_id, line::BIGINT AS line, kind, detail FROM h CROSS JOIN i WHERE length(repository_id) % 2 = 0""",
    "path_owners": f"SELECT repository_id, path, owners, line FROM ({OWNED_SQL})",
    "unowned_paths": f"SELECT repository_id, path FROM ({OWNED_SQL}) WHERE owners = ''",
    "symbol_owners": f"""
SELECT page_id::VARCHAR AS symbol_id, path, owners, CASE WHEN line > 0 THEN source_path || ':' || line ELSE '' END AS refs
FROM ({PAGES_SQL}) JOIN ({OWNED_SQL}) USING (repository_id, path) WHERE ends_with(path, '.py')""",
    "ownership_contexts": f"""
SELECT repository_id, CASE WHEN length(repository_id) % 2 = 0 THEN 'CODEOWNERS' ELSE 'docs/CODEOWNERS' END AS source_path,
  CASE WHEN length(repository_id) % 4 = 0 THEN 7 WHEN length(repository_id) % 2 = 0 THEN 6 ELSE 1 END::BIGINT AS rules,
  CASE WHEN length(repository_id) % 2 = 0 THEN 8 ELSE 0 END::BIGINT AS issues, count(*) AS paths,
  count(*) FILTER (line = 0) AS unowned_paths, length(repository_id) % 2 = 1 AS complete
FROM ({OWNED_SQL}) GROUP BY repository_id""",
    "declared_owners": f"""
SELECT DISTINCT repository_id, o.split_part(':', 2) AS identifier, o.split_part(':', 1) AS kind
FROM (SELECT repository_id, unnest(string_split(owners, ',')) AS o FROM ({RULES_SQL}))""",
    "name_projections": rf"""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, CASE WHEN p_size % 2 = 0 THEN 'src/' ELSE 'lib/' END || replace(p_name, ' ', '_') || '/'
  || CASE WHEN p_size % 5 = 0 THEN '__init__' ELSE 'test_' || p_size END || '.py' AS path FROM part),
m AS (SELECT *, {_module} AS sm, string_split({_module}, '.') AS parts, p_size % 4 AS lv,
  p_size % 4 - (p_size % 5 = 0)::INT AS drops FROM p)
SELECT p_partkey, path, sm AS stripped_module, replace(regexp_replace({_stem}, '/__init__$', ''), '/', '.') AS plain_module,
  CASE WHEN lv = 0 THEN 'x.y' ELSE array_to_string(list_concat(parts[:greatest(len(parts) - drops, 0)], ['x', 'y']), '.') END AS base,
  p_size % 5 <> 0 AS is_test, true AS analysed,
  regexp_replace(regexp_replace('#' || p_brand || ' ' || p_name, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  regexp_replace(regexp_replace(lower(p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS metric,
  p_size > 40 AS escapes, p_size >= 5 AS public,
  array_to_string(list_sort(list_distinct([lower(t) FOR t IN regexp_extract_all(p_name || ' ' || path, '[A-Za-z][A-Za-z0-9]+')
    IF length(t) > 2 AND lower(t) NOT IN ('test', 'tests', 'context', 'build', 'changed', 'change', 'python')])), ',') AS tokens
FROM m""",
}
