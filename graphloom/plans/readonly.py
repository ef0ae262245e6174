"""SQL texts of users: a text runs only if all it is made of is on the lists below."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: What a parsed query may be made of.
NODES = frozenset(
    """Project Filter Aggregate Join LateralJoin Generate Sort GlobalLimit LocalLimit Offset Window Distinct Deduplicate Union Intersect Except
    SubqueryAlias UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition
    UnresolvedSubqueryColumnAliases UnresolvedHint Pivot Unpivot""".split()
)
#: Names that the parser leaves for later; all other expressions of a parsed text are Spark's own operators and literals.
UNRESOLVED = frozenset(
    """UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedFunction UnresolvedExtractValue UnresolvedOrdinal UnresolvedGenerator
    UnresolvedSubqueryColumnAliases UnresolvedNamedLambdaVariable UnresolvedWindowExpression MultiAlias PosParameter NamedParameter""".split()
)
FUNCTIONS = frozenset(
    """count count_if sum avg mean min max min_by max_by first last any_value some any every bool_and bool_or collect_list collect_set array_agg listagg
    approx_count_distinct percentile percentile_approx median mode stddev variance corr grouping grouping_id
    row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value
    coalesce ifnull nvl nvl2 nullif if isnull isnotnull isnan greatest least typeof
    abs ceil ceiling floor round bround sign signum sqrt exp ln log log2 log10 pow power mod pmod div cast bigint int double string boolean
    lower lcase upper ucase initcap length char_length character_length octet_length substring substr substring_index left right trim ltrim rtrim btrim
    lpad rpad repeat reverse concat concat_ws replace translate split split_part instr locate position between contains startswith endswith like ilike rlike regexp
    regexp_like regexp_count regexp_extract regexp_extract_all regexp_replace regexp_instr regexp_substr levenshtein soundex ascii chr
    md5 sha sha1 sha2 crc32 hash xxhash64 hex
    array size cardinality array_size array_contains array_position array_distinct array_union array_intersect array_except array_join array_min array_max
    array_sort sort_array array_append array_prepend array_compact array_remove arrays_overlap arrays_zip element_at try_element_at get slice flatten
    transform filter exists forall aggregate reduce zip_with explode explode_outer posexplode posexplode_outer inline inline_outer
    struct named_struct map map_keys map_values map_entries map_from_entries map_contains_key to_json from_json
    to_number to_char try_cast try_add try_subtract try_multiply try_divide try_sum try_avg and or not""".split()
)

_ANALYSIS = "org.apache.spark.sql.catalyst.analysis."


def check(spark: SparkSession, text: str, views: frozenset[str]) -> None:
    """Raise ValueError unless the text is one query over `views` alone that writes nothing and calls listed functions only.

    Spark's parser reads the text, and nothing of it is resolved or run before every node,
    expression, relation and function name is found on a list; so a kind of statement that is not
    known here is refused, whatever it does. Names are compared in lower case, as Spark does it.
    """
    if not text.strip():
        raise ValueError("an empty text is no query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JError) as error:
        raise ValueError(f"no query: {error}") from None
    _plan(plan, views)


def _kind(node: JavaObject) -> tuple[str, str]:
    kind = node.getClass()
    return kind.getSimpleName().rstrip("$"), kind.getName()


def _each(items: JavaObject) -> Iterator[JavaObject]:
    for k in range(items.size()):
        yield items.apply(k)


def _classes(kind: JavaObject | None) -> Iterator[JavaObject]:
    while kind is not None:
        yield kind
        kind = kind.getSuperclass()


def _plan(node: JavaObject, known: frozenset[str]) -> None:
    kind, _ = _kind(node)
    if kind not in NODES:
        raise ValueError(f"{kind} is not allowed in a query")
    if kind == "UnresolvedRelation":
        name = [str(x) for x in _each(node.multipartIdentifier())]
        if len(name) != 1 or name[0].lower() not in known or node.isStreaming():
            raise ValueError(f"no such view: {'.'.join(name)}")
    if kind == "UnresolvedWith":
        for relation in _each(node.cteRelations()):
            name, body = str(relation._1()).lower(), relation._2()
            _plan(body, known | {name} if node.allowRecursion() else known)
            known = known | {name}
    for expression in _each(node.expressions()):
        _expression(expression, known)
    for child in _each(node.children()):
        _plan(child, known)


def _expression(node: JavaObject, known: frozenset[str]) -> None:
    kind, name = _kind(node)
    if not name.startswith("org.apache.spark.sql.catalyst.expressions.") and not (name.startswith(_ANALYSIS) and kind in UNRESOLVED):
        raise ValueError(f"{kind} is not allowed in a query")
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = [str(x) for x in _each(node.nameParts())] if kind == "UnresolvedFunction" else [node.name().funcName()]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise ValueError(f"no such function here: {'.'.join(parts)}")
    if any(c.getName().endswith(".SubqueryExpression") for c in _classes(node.getClass())):
        _plan(node.plan(), known)
    for child in _each(node.children()):
        _expression(child, known)
