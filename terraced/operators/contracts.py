"""Contracts between products, read from published manifests."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = (
    "struct<resource_type:string,package_name:string,access:string,name:string,database:string,schema:string,"
    "alias:string,original_file_path:string,path:string,fqn:array<string>>"
)
MANIFEST_SCHEMA = f"struct<nodes:map<string,{_NODE}>>"

# Scopes in the order in which a node's text is searched for them.
SCOPE_ORDER = ("depot_transactions", "customers", "taxes", "orders")

# Parts of a node whose text names its scope.
_SCOPE_PARTS = ("package_name", "name", "alias", "original_file_path", "path")


def _through(first: str, rest: str, otherwise: str = "") -> str:
    """Pattern of a text through its first mark of two parts; what was read is never read again."""
    return rf"(?>[^{first}]*)(?:{first}(?!{rest})[^{first}]*)*+(?:{first}{rest}{otherwise})"


_END = r"|\z"
_RAW, _ENDRAW = r"%[-+]?\s*raw\s*[-+]?%", r"%[-+]?\s*endraw\s*[-+]?%\}"
_TEMPLATE_COMMENT, _RAW_SECTION = "#" + _through("#", r"\}", _END), _RAW + r"\}" + _through(r"\{", _ENDRAW, _END)
_EXPRESSION, _STATEMENT = r"\{" + _through(r"\}", r"\}"), "%" + _through("%", r"\}")
# What a model text holds besides plain text, from its second character: comments and raw sections, which come first, and
# blocks with their content, which are group 1. An unfinished one reaches to the end, so that no text is searched twice.
_BLOCKS = rf"(?s)\{{(?:{_TEMPLATE_COMMENT}|{_RAW_SECTION}|({_EXPRESSION}|(?!{_RAW}){_STATEMENT})|{_STATEMENT}|[{{%].*)"
# One match per comment of the SQL and one for the rest: group 1 is what stands before it, blocks and quoted text as a whole.
_SHOWN = rf"""[^{{'"/-]+|\{{(?:{_EXPRESSION}|{_STATEMENT}|[{{%].*)|'[^']*'|"[^"]*"|(?!--|/\*)."""
_SQL_COMMENTS = rf"(?s)(?!\z)((?:{_SHOWN})*+)(?:--[^\n]*|/\*{_through(r'\*', '/', _END)}|\z)"
_STRING = r"""'[^'\\]*(?:\\.[^'\\]*)*+(?:'|$)|"[^"\\]*(?:\\.[^"\\]*)*+(?:"|$)"""
_CALL = r"""(?:builtins\.)?ref\s*\(\s*(?:'[^']*'|"[^"]*")\s*(?:,\s*(?:'[^']*'|"[^"]*")\s*)?(?=[,)])"""
# One match per call, group 1, with the quoted text and the words around it; others, without the group, lead to the end.
_NO_CALL = rf"""(?:[^\w.'"]+|{_STRING}|(?!(?:builtins\.)?ref\s*\()[\w.]+)*+"""
_CALLS = rf"(?s)(?!\z){_NO_CALL}(?:({_CALL}){_NO_CALL}|[\w.]+|\z)"
_WHITE = " \t\n\x0b\f\r"


def read_manifests(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Manifest texts, gzip or plain: one per file, or one per line."""
    return spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("manifest"))


def nodes(manifests: DataFrame) -> DataFrame:
    """One row per node of every manifest, keeping the other columns."""
    parsed = F.from_json("manifest", MANIFEST_SCHEMA)
    kept = [c for c in manifests.columns if c != "manifest"]
    return manifests.select(*kept, F.explode(parsed["nodes"]).alias("node_id", "node")).select(*kept, "node_id", "node.*")


def _filled(name: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(text != "", text)


def public_contract(node_rows: DataFrame, producer: str) -> DataFrame:
    """Relations a producer publishes; nodes without name, database or schema are left out."""
    published = node_rows.filter(
        (F.col("resource_type") == "model") & (_filled("package_name") == producer) & (_filled("access") == "public")
    )
    return published.select(
        _filled("name").alias("name"),
        _filled("database").alias("database"),
        _filled("schema").alias("schema"),
        F.coalesce(_filled("alias"), _filled("name")).alias("alias"),
    ).dropna(subset=["name", "database", "schema"])


def require_public(contract: DataFrame, producer: str) -> DataFrame:
    if contract.isEmpty():
        raise LookupError(f"the manifest of {producer} publishes no relations")
    return contract


def scope_of(text: Column) -> Column:
    """First scope the text mentions, in search order; NULL when none."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(scope), scope) for scope in SCOPE_ORDER])


def retarget(node_rows: DataFrame, database_of: Mapping[str, str]) -> DataFrame:
    """Point each node with a database at the database of its scope, where one is given."""
    if not database_of:
        return node_rows
    text = F.concat_ws(" ", *_SCOPE_PARTS, F.array_join("fqn", " "))
    moved = F.coalesce(_target(database_of, text), F.col("database"))
    return node_rows.withColumn("database", F.when(_filled("database").isNotNull(), moved).otherwise(F.col("database")))


def _target(database_of: Mapping[str, str], text: Column) -> Column:
    """The database given for the scope of a text; NULL where none is."""
    targets = F.create_map(*[F.lit(v) for v in chain.from_iterable(database_of.items())])
    return F.element_at(targets, scope_of(text))


def rewrite_manifests(manifests: DataFrame, database_of: Mapping[str, str]) -> DataFrame:
    """The same manifests as documents, each node with a database pointed at the database of its scope.

    Nothing but ``database`` changes: fields, nodes and sections that the contract
    schema does not know come through, whatever their types. Members come out in
    the order of their names and numbers in their shortest form. Nodes that are no
    objects, or whose database is missing, blank or no text, stay as they are, and
    so do documents without an object ``nodes`` and texts that are no JSON object
    or repeat a member's name. No shuffle and no Python: one projection.
    """
    if not database_of:
        return manifests

    def members(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def text(fields: Column, name: str) -> Column:
        return F.try_variant_get(F.element_at(fields, name), "$", "string")

    def moved(node: Column) -> Column:
        fields = members(node)
        fqn = F.array_join(F.try_variant_get(F.element_at(fields, "fqn"), "$", "array<string>"), " ")
        found = _target(database_of, F.concat_ws(" ", *[text(fields, part) for part in _SCOPE_PARTS], fqn))
        pointed = F.schema_of_variant(F.element_at(fields, "database")) == "STRING"
        pointed &= (F.trim(text(fields, "database")) != "") & found.isNotNull()
        rebuilt = F.transform_values(fields, lambda name, value: F.when(name == "database", found.cast("variant")).otherwise(value))
        return F.when(pointed, F.to_variant_object(rebuilt)).otherwise(node)

    document = members(F.try_parse_json("manifest"))
    node_map = members(F.element_at(document, "nodes"))
    rebuilt_nodes = F.to_variant_object(F.transform_values(node_map, lambda _, node: moved(node)))
    rebuilt = F.transform_values(document, lambda name, value: F.when(name == "nodes", rebuilt_nodes).otherwise(value))
    return manifests.withColumn("manifest", F.when(node_map.isNotNull(), F.to_json(rebuilt)).otherwise(F.col("manifest")))


def write_manifests(manifests: DataFrame, path: str, whole_files: bool = True) -> None:
    """Gzip files with one manifest each, or one per line; ``read_manifests`` reads them back."""
    writer = manifests.select("manifest").write.option("compression", "gzip")
    (writer.option("maxRecordsPerFile", 1) if whole_files else writer).text(path)


def text_references(texts: DataFrame, column: str = "text", in_sql_comments: bool = True, package: str | None = None) -> DataFrame:
    """One row per ``ref('name')`` or ``ref('package', 'name')`` in model texts, beside the other columns.

    Only calls within ``{{ }}`` and ``{% %}`` count; template comments, raw sections
    and quoted text within blocks hold none. A comment of the SQL does not hide a
    block, as templates are filled in first; ``in_sql_comments=False`` leaves those
    out too. ``package`` is NULL for one name. Null and empty texts have no
    references. A quoted ``}}`` or ``%}`` ends its block. With a ``package`` only references
    to it come out, and blocks that do not mention it are not searched for calls.
    """
    kept = [F.col(c) for c in texts.columns if c != column]
    text = F.col(column)
    if not in_sql_comments:
        text = F.regexp_replace(F.regexp_replace(text, rf"(?s)\{{{_TEMPLATE_COMMENT}", " "), _SQL_COMMENTS, "$1")
    blocks = texts.select(*kept, F.explode(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(1))).alias("_block"))
    calling = blocks.filter(F.col("_block").contains("ref") & F.col("_block").contains(package or ""))
    found = calling.select(*kept, F.explode(F.regexp_extract_all("_block", F.lit(_CALLS), F.lit(1))).alias("_call")).filter("_call <> ''")
    # Quotes part a call: the first name follows the first one, and the last name the last but one if a comma stands before that.
    call = F.replace("_call", F.lit('"'), F.lit("'"))
    first = F.substring_index(F.substring_index(call, "'", 2), "'", -1)
    second = F.substring_index(F.substring_index(call, "'", -2), "'", 1)
    two = F.rtrim(F.substring_index(F.substring_index(call, "'", -3), "'", 1), F.lit(_WHITE)).endswith(",")
    references = found.select(*kept, F.when(two, first).alias("package"), F.when(two, second).otherwise(first).alias("name"))
    return references if package is None else references.filter(F.col("package") == package)


def unresolved_in_texts(references: DataFrame, contract: DataFrame, producer: str) -> DataFrame:
    """References to ``producer`` that its contract does not publish, with how often each is used."""
    return unresolved(references.filter(F.col("package") == producer), contract)


def unresolved(references: DataFrame, contract: DataFrame) -> DataFrame:
    """References (``name``) to relations the producer does not publish, with how often each is used.

    References are counted per name first; the anti join then moves names, not uses.
    """
    used = references.groupBy("name").agg(F.count("*").alias("uses"))
    return used.join(contract.select("name").distinct(), "name", "left_anti")
