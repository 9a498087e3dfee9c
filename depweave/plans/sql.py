"""SQL twins of the views, and a small helper that puts them before a query."""

from __future__ import annotations

from depweave.functions.paths import TEST_PATTERNS

PATH = "p_brand || '/' || p_type || '/p' || p_partkey || '.py'"
DIR = "CASE WHEN strpos({0}, '/') = 0 THEN '.' ELSE regexp_replace({0}, '/[^/]*$', '') END"
TEST = "|".join(TEST_PATTERNS)

VIEWS = {
    "occ": f"""SELECT 'idx' AS index_id, l_orderkey AS doc_ord, (l_linenumber * CAST(1000000 AS BIGINT) + l_suppkey) * 1000000 + l_partkey AS occ_ord, {PATH} AS path,
        'o' || l_orderkey || CASE WHEN o_custkey % 2 = 0 THEN '().' ELSE '' END AS symbol, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS roles, [17, 26, 9, 7, 0][o_custkey % 5 + 1] AS kind
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "defs": "SELECT symbol, path FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_ord DESC, occ_ord DESC) AS rn FROM occ WHERE roles % 2 = 1) WHERE rn = 1",
    "kinds": "SELECT symbol, kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_ord DESC, occ_ord DESC) AS rn FROM occ WHERE kind <> 0) WHERE rn = 1",
    "listed": "SELECT symbol, path FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_ord DESC, occ_ord DESC) AS rn FROM occ) WHERE rn = 1",
    "refs": "SELECT path, symbol, count(*) AS cnt FROM occ WHERE roles % 2 = 0 GROUP BY ALL",
    "resolved": """SELECT r.path, r.symbol, d.path AS def_path, r.cnt, CASE WHEN k.kind IS NOT NULL THEN k.kind IN (17, 26, 9) ELSE ends_with(r.symbol, '().') END AS callable
        FROM refs r JOIN defs d USING (symbol) LEFT JOIN kinds k USING (symbol) WHERE r.path <> d.path""",
    "fedges": """SELECT least(path, def_path) AS src, greatest(path, def_path) AS dst, 'import' AS edge_type, CAST(sum(cnt) AS BIGINT) AS cnt FROM resolved GROUP BY 1, 2
        UNION ALL SELECT least(path, def_path), greatest(path, def_path), 'call', CAST(sum(cnt) AS BIGINT) FROM resolved WHERE callable GROUP BY 1, 2""",
    "weighted": "SELECT src, dst, sum(log2(1 + cnt) * CASE edge_type WHEN 'call' THEN 1.0::DOUBLE WHEN 'import' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM fedges GROUP BY ALL",
    "nodes": "SELECT DISTINCT path AS node FROM occ",
    "deg": "SELECT node, count(*) AS degree FROM (SELECT src AS node, dst AS o FROM weighted UNION SELECT dst, src FROM weighted) GROUP BY 1",
    "pfiles": f"SELECT {PATH} AS path, p_brand AS component FROM part",
    "ch": """SELECT CASE WHEN event_id % 11 = 0 THEN 'module' ELSE 'decision' END AS entity_type, CASE WHEN event_id % 7 = 0 THEN event_id + 100000000 ELSE (event_id * event_id) % 2003 END AS entity_id,
        CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'edit' END AS action, CASE WHEN event_type <> 'signup' THEN props END AS old_value, CASE WHEN event_type <> 'error' THEN props END AS new_value,
        user_id AS module_id, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS baseline_id, event_id AS ord FROM events""",
    "mods": "SELECT CAST(r_regionkey AS BIGINT) AS module_id, r_name AS name, ['module', 'shared-library', 'supporting-asset'][r_regionkey % 3 + 1] AS classification, CASE WHEN r_regionkey <> 4 THEN 'in-repo' END AS source_origin FROM region",
    "mdirs": "SELECT CAST(n_regionkey AS BIGINT) AS module_id, lower(n_name) AS directory FROM nation",
    "comps": "SELECT CAST(n_nationkey AS BIGINT) AS component_id, CAST(n_regionkey AS BIGINT) AS module_id, n_name AS name, 'serves ' || lower(n_name) AS purpose, (n_nationkey % 10) / 10.0::DOUBLE AS confidence FROM nation",
    "cfiles": """SELECT CAST(c_nationkey AS BIGINT) AS component_id, 'nation_' || c_nationkey || '/c' || c_custkey || '.py' AS path, false AS is_test FROM customer
        UNION ALL SELECT s_nationkey, 'nation_' || s_nationkey || '/tests/s' || s_suppkey || '.py', true FROM supplier""",
    "decs": """SELECT o_orderkey AS decision_id, CASE WHEN o_custkey % 4 = 0 THEN CAST(n_regionkey AS BIGINT) END AS module_id, CASE WHEN o_custkey % 4 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS component_id, o_orderpriority AS category,
        'Rule  ' || (o_orderkey % 97) AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'because ' || o_orderstatus END AS detail, CASE WHEN o_orderstatus = 'F' THEN 'human' ELSE 'pipeline_generated' END AS source
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "medges": """SELECT source_id, (source_id + k) % 5 AS target_id, ['depends_on', 'uses_data_store', 'communicates_via'][source_id % 3 + 1] AS edge_type, k * 1.5::DOUBLE AS weight,
        CASE WHEN k = 1 THEN '{"label": "m' || source_id || '"}' ELSE 'oops' END AS metadata FROM (SELECT module_id AS source_id, unnest([1, 2]) AS k FROM mods)""",
    "cedges": """SELECT source_id, target_id, CASE WHEN (source_id + target_id) % 2 = 0 THEN 'call' ELSE 'import' END AS edge_type, CAST(count(*) AS DOUBLE) AS weight FROM (
        SELECT CAST(c_nationkey AS BIGINT) AS source_id, CAST(s_nationkey AS BIGINT) AS target_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        WHERE source_id <> target_id GROUP BY source_id, target_id""",
    "v1": "SELECT o_orderkey AS decision_id, o_orderpriority AS category, o_orderstatus AS text, 'c' || (o_custkey % 9) AS component_name, 'm' || (o_custkey % 3) AS module_name, 'human' AS source FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'",
    "v2": """SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 10 = 0 THEN 'new ' || o_orderpriority ELSE o_orderpriority END AS category, o_orderstatus AS text, 'c' || (o_custkey % 8) AS component_name, 'm' || (o_custkey % 3) AS module_name,
        CASE WHEN o_orderkey % 4 = 0 THEN 'chat' ELSE 'human' END AS source FROM orders WHERE o_orderkey % 11 <> 0""",
    "outc": """SELECT event_id AS ord, user_id AS run_id, event_id * 7 % 5000 AS decision_id, ['confirmed', 'updated', 'outdated', 'new', 'implemented', 'diverged', 'unchanged'][event_id % 7 + 1] AS status, 'text ' || event_id AS new_text FROM events""",
    "vruns": "SELECT user_id AS run_id, min(ts) AS created_at, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY user_id",
    "rfiles": """SELECT DISTINCT CASE WHEN d = '' THEN n ELSE d || '/' || n END AS path FROM (
        SELECT ['src', 'src/core', 'node_modules/lib', 'tests', 'build/out', 'spec/unit', '', 'docs/api', 'pkg/vendor'][(o_orderkey // 18) % 9 + 1] AS d, CASE WHEN o_orderkey % 4 = 0 THEN b ELSE o_custkey || '_' || b END AS n FROM (
        SELECT *, ['app.py', 'Main.java', 'lib.rs', 'x.TS', 'y.ts', 'util.h', 'mod.go', 'README', 'notes.txt', 'package.json', 'web.csproj', 'a.min.js', '.env', 'test_app.py', 'conftest.py', 'data.xyz', 'q.XYZ', 'logo.png'][o_orderkey % 18 + 1] AS b FROM orders))""",
    "resp": r"""SELECT event_id AS request_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '  ' || props || chr(10) WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done'
        WHEN 3 THEN '```' || chr(10) || props || chr(10) || '```' WHEN 4 THEN 'I think ' || props || ' is right.' WHEN 5 THEN 'no answer' WHEN 6 THEN '[' || props || ']' END AS text FROM events""",
}

#: What each view reads of the others.
NEEDS = {
    "defs": ["occ"], "kinds": ["occ"], "listed": ["occ"], "refs": ["occ"], "resolved": ["refs", "defs", "kinds"], "fedges": ["resolved"], "weighted": ["fedges"], "nodes": ["occ"], "deg": ["weighted"], "medges": ["mods"],
}


def query(final: str, *views: str, **own: str) -> str:
    """``final`` after WITH: the named views with what they need, then its own, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({text})" for n, text in own.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {final}" if parts else final
