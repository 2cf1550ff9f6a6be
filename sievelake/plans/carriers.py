"""The test tables seen as a corpus: orders are files, line items are findings, diff lines or snippets of code.

The tables hold no source code, so code is put together from fixed snippets, one
for each line item, whose findings are known by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Titles of the findings.
TITLES = ("Bare except clause", "E722: Do not use bare `except`", "Detected use of eval() with user input", "Use of eval() with untrusted user input", "Leftover print() call", "Unused import <os> | [x](y)")

#: Snippets and what they hold, as (rule, line, last line, severity).
PYTHON = (
    ("try:\n    pass\nexcept:\n    pass\n", [(1, 3, 3, "medium")]),
    ('name = "x"\nfrappe.db.sql(f"select * from tab where name = {name}")\n', [(2, 2, 2, "high")]),
    ('frappe.db.sql(\n    "select %s" % frappe.db.escape(name)\n)\n', [(2, 1, 3, "medium")]),
    ("for name in names:\n    doc = frappe.get_doc('Item', name)\n", [(4, 2, 2, "medium")]),
    ("for x in frappe.get_all('Item'):\n    x.get_value('a')\n", [(4, 1, 1, "medium")]),
    ("frappe.db.commit()\nfrappe.local.db.commit()\nrepo.commit()\n", [(5, 1, 1, "medium"), (5, 2, 2, "medium")]),
    ('frappe.throw("Something went wrong")\nfrappe.throw(_("Something"))\nfrappe.msgprint("a" + b)\nthrow("%s" % a)\n', [(6, 1, 1, "low"), (6, 3, 3, "low")]),
    ('print("debug")\nlog.print("x")\n', [(7, 1, 1, "low")]),
    ("try:\n    pass\nexcept ValueError:\n    'why'\n", [(8, 3, 3, "medium")]),
    ("try:\n    pass\nexcept (KeyError, ValueError) as e:\n    log(e)\n", []),
    ('api_key = "sk-abc123realvalue"\nother_key = "changeme"\ntoken = "changeme"\n', [(9, 1, 1, "high")]),
    ("doc = frappe.get_doc('Item', name)\nfrappe.db.sql('select %s', (name,))\n", []),
    ("def big():\n" + "".join(f"    x{k} = {k}\n" for k in range(52)) + "    return x1\n", [(18, 1, 1, "low")]),
    ("async def small():\n    return 1\n", []),
)
GUARDS = (
    ("@frappe.whitelist()\ndef do_thing():\n    return 1\n", [(3, 2, 2, "high")]),
    ("@frappe.whitelist()\ndef save(bp):\n    bp.check_permission('write')\n", []),
    ("@frappe.whitelist(allow_guest=True)\ndef open_one():\n    return 1\n", []),
    ("@frappe.whitelist()\ndef dead():\n    def _check():\n        frappe.has_permission('X', throw=True)\n    return 1\n", [(3, 2, 2, "high")]),
    ("@frappe.whitelist()\ndef helper():\n    def _check():\n        frappe.has_permission('X', throw=True)\n    _check()\n", []),
    ("@frappe.whitelist()\ndef far():\n    def _b():\n        raise frappe.PermissionError\n    def _a():\n        _b()\n    _a()\n", []),
    ("@whitelist\ndef shadow():\n    def _check():\n        frappe.has_permission('X')\n    def inner():\n        def _check():\n            pass\n        _check()\n    inner()\n", [(3, 2, 2, "high")]),
    ("@frappe.whitelist()\ndef shadow_ok():\n    def _check():\n        frappe.has_permission('X')\n    def inner():\n        def _check():\n            pass\n    _check()\n", []),
    ("@frappe.whitelist()\nasync def in_lambda():\n    return lambda: frappe.has_permission('X')\n", [(3, 2, 2, "high")]),
    ("def plain():\n    return 1\n", []),
)
SCRIPT = (
    ('frm.$wrapper.append("<button>Click</button>");\n', [(10, 1, 1, "medium")]),
    ("$el.html(\"<div style='color:red'></div>\");\n", [(11, 1, 1, "low")]),
    ("let a = 1;\nconsole.log('debug');\n", [(12, 2, 2, "low")]),
    ("debugger;\nmy.debugger;\nmydebugger;\n", [(13, 1, 1, "high")]),
    ("$('#some-id').hide();\njQuery ('x');\n", [(14, 1, 1, "low"), (14, 2, 2, "low")]),
    ("$($wrapper).find('.btn').hide();\n$(frm.fields_dict.x);\n", []),
    ("const api_key = 'sk-abc123realvalue';\n", [(16, 1, 1, "high")]),
    ("const api_key = 'changeme';\n\n", []),
    ('console.debug("<input type=text style=\'x\'>"); debugger ;\n', [(10, 1, 1, "medium"), (11, 1, 1, "low"), (12, 1, 1, "low"), (13, 1, 1, "high")]),
)
#: Calls: for each line of a snippet whether a call begins there and whether it shows handling.
CALLS = (
    ("frappe.call({\n    method: 'my.method',\n});\n", "c.."),
    ("frappe.call({\n    method: 'm',\n    error: (e) => show(e),\n});\n", "c.h."),
    ("frappe\n\t.call({\n\t\tmethod: 'my.method',\n\t});\n", "c..."),
    ("".join(f"let a{k} = {k};\n" for k in range(13)), "." * 13),
    ("x = {\n  freeze : true,\n};\n", ".h."),
    ("let terror = 1;\nfrappe . call (x);\nfrappe.callback(x);\n", ".ch"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(key: Column, values: list | tuple) -> Column:
    """values[key % len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ord, their place in their order."""
    return read(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("bigint"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each line item: file, ord, check_id, tier, source, severity, title, line_start, line_end."""
    flags = F.concat("l_returnflag", "l_linestatus")
    level = F.when(flags == "NO", "low").when(flags == "RF", "medium").when(flags == "AF", "high").when(flags == "NF", "critical").otherwise("info")
    line = F.col("l_linenumber").cast("int")
    return items(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("file"), "ord", F.concat(F.lit("RULE-00"), (F.col("l_partkey") % 6 + 1).cast("string")).alias("check_id"),
        choice(F.col("l_suppkey"), ("cloud_llm", "local_llm", "rules", "rules", "rules")).alias("tier"), choice(F.col("l_suppkey"), ("house", "ruff", "eslint", "semgrep")).alias("source"),
        level.alias("severity"), choice(F.col("l_partkey"), TITLES).alias("title"), line.alias("line_start"), F.when(F.col("l_suppkey") % 3 == 1, line).when(F.col("l_suppkey") % 3 == 2, line + 1).alias("line_end"),
        "l_orderkey",
    )


def changed(key: Column) -> Column:
    """Changed lines by key % 3: all (null), none, the odd ones up to 41."""
    return F.when(key % 3 == 1, F.array().cast("array<int>")).when(key % 3 == 2, F.array(*[F.lit(k) for k in range(1, 42, 2)]))


def code(spark: SparkSession, sf_dir: str, snippets: tuple, suffix: str) -> DataFrame:
    """path, status, changed_lines, content: a file for each order, one snippet for each line item."""
    part = F.struct("ord", choice(F.col("l_partkey") + F.col("l_suppkey"), [s for s, *_ in snippets]).alias("s"))
    rows = items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("content"))
    return rows.select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(suffix)).alias("path"), F.lit("modified").alias("status"), changed(F.col("l_orderkey")).alias("changed_lines"), "content")
