"""From a mapping and its sources to one lazy statement DataFrame.

Per logical source there is one scan and one fan-out: the terms of all its triples maps become
columns, and a single generator turns a row into its statements. Parents that a join finds at most
once are joined onto that scan before the fan-out, so that they cost no further scan of the child.
Other parent joins are separate narrow branches that carry keys and terms only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping as MappingType, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.errors import MappingError
from quadweave.functions import FunctionRegistry, default_functions
from quadweave.model import (
    BNODE,
    IRI,
    Mapping,
    ParentObject,
    Source,
    TermMap,
    TriplesMap,
    expand_pairs,
)
from quadweave.operators import terms
from quadweave.operators.schema import complete, no_statements, sql_text, statement_columns, statement_sql
from quadweave.plans import rewrite
from quadweave.sources.logical import load_source
from quadweave.vocab import DEFAULT_GRAPH, RDF_TYPE


@dataclass
class Setup:
    """What configurers may change before the mapping is compiled."""

    sources: dict[str | None, DataFrame]
    functions: FunctionRegistry
    transforms: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


def run_mapping(
    mapping: Mapping,
    spark: SparkSession,
    sources: MappingType[str | None, DataFrame],
    *,
    root: str | None,
    base_iri: str,
    functions: FunctionRegistry | None,
    configure: Sequence[Callable[[Setup], None]],
    limit: int | None,
    distinct: bool,
    subject: str | None,
    on_invalid: str,
    iri_safe: str,
    natural_types: bool,
) -> DataFrame:
    terms.check_iri(base_iri)
    if on_invalid not in ("keep", "drop", "fail"):
        raise MappingError(f"on_invalid is 'keep', 'drop' or 'fail', not '{on_invalid}'")
    setup = Setup(dict(sources), (functions or default_functions()).copy())
    for configurer in configure:
        configurer(setup)
    context = terms.TermContext(base_iri, setup.functions, iri_safe, natural_types)

    references = referenced_columns(mapping)
    frames = {
        source: load_source(spark, source, names, setup.sources, root) for source, names in references.items()
    }
    early_distinct = distinct and limit is None and not setup.transforms
    compiler = Compiler(mapping, frames, context, subject, early_distinct)
    result = compiler.statements(spark)
    result = _residual_filter(result, mapping)
    if subject is not None:
        result = result.where(F.col("s") == subject)
    result = _check_iris(result, on_invalid)
    for transform in setup.transforms:
        result = result.transform(transform)
    if limit is not None:
        result = result.limit(limit)
    if distinct and not compiler.is_set:
        multi = {s: {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)} for s, df in frames.items()}
        # Transforms are opaque, so nothing can be proven about their output.
        if setup.transforms or not rewrite.provably_distinct(mapping, base_iri, multi):
            result = result.dropDuplicates()
    return result


def referenced_columns(mapping: Mapping) -> dict[Source, list[str]]:
    """Every source with the references any triples map or join takes from it."""
    found: dict[Source, dict[str, None]] = {}

    def note(source: Source, names) -> None:
        found.setdefault(source, {}).update(dict.fromkeys(names))

    for item in mapping.maps:
        branches = list(expand_pairs(item))
        if not branches:
            continue
        note(item.source, item.subject.all_references())
        for predicate, obj, graphs in branches:
            for term in (predicate, *graphs):
                note(item.source, term.all_references())
            if isinstance(obj, TermMap):
                note(item.source, obj.all_references())
                continue
            other = mapping.find(obj.parent)
            note(other.source, other.subject.all_references())
            for join in obj.joins:
                note(item.source, [join.child])
                note(other.source, [join.parent])
    return {source: list(names) for source, names in found.items()}


def _residual_filter(frame: DataFrame, mapping: Mapping) -> DataFrame:
    """Row filter for what :func:`rewrite.prune` could not decide on the mapping alone."""
    if not mapping._residual:
        return frame
    predicates, classes, graphs = mapping._residual
    if predicates is not None:
        frame = frame.where(F.col("p").isin(sorted(predicates)))
    if classes is not None:
        frame = frame.where((F.col("p") != RDF_TYPE) | F.col("o").isin(sorted(classes)))
    if graphs is not None:
        named = sorted(graphs - {DEFAULT_GRAPH})
        condition = F.col("g").isin(named) if named else F.lit(False)
        condition = F.coalesce(condition, F.lit(False))
        if DEFAULT_GRAPH in graphs:
            condition = condition | F.col("g").isNull()
        frame = frame.where(condition)
    return frame


def _check_iris(frame: DataFrame, on_invalid: str) -> DataFrame:
    if on_invalid == "keep":
        return frame
    checks = [
        (F.col("s_kind") != IRI) | terms.is_valid_iri(F.col("s")),
        terms.is_valid_iri(F.col("p")),
        (F.col("o_kind") != IRI) | terms.is_valid_iri(F.col("o")),
    ]
    valid = reduce(lambda a, b: a & b, checks)
    if on_invalid == "drop":
        return frame.where(valid)
    message = F.concat(F.lit("statement with an invalid IRI: "), F.concat_ws(" ", "s", "p", "o"))
    return frame.where(F.when(valid, True).otherwise(F.raise_error(message).cast("boolean")))


@dataclass(frozen=True)
class _Part:
    """A term inside the fan-out, as SQL text: a projected column (maybe an array) or a constant."""

    sql: str
    multi: bool
    kind: str
    datatype: str | None = None
    language: str | None = None

    @property
    def is_constant(self) -> bool:
        return self.sql.startswith("'")


class _Projection:
    """Collects the term columns of one scan; equal terms are computed once."""

    def __init__(self, scope: dict[str, terms.Reference], context: terms.TermContext) -> None:
        self.scope = scope
        self.context = context
        self.columns: list[Column] = []
        self._names: dict = {}

    def _keep(self, key, column: Column) -> str:
        if key not in self._names:
            self._names[key] = f"_t{len(self.columns)}"
            self.columns.append(column.alias(self._names[key]))
        return self._names[key]

    def part(self, term: TermMap, position: str) -> _Part:
        kind = terms.term_kind(term, position)
        if term.kind == "constant" and kind != BNODE:
            sql = sql_text(terms.constant_text(term, kind, self.context))
            multi = False
        else:
            multi = terms.is_multi(term, self.scope, self.context)
            key = (term.kind, term.value, term.args, kind)
            sql = self._names.get(key) or self._keep(
                key, terms.term_value(term, position, self.scope, self.context)
            )
        language = None
        if term.language is not None and term.language.kind == "constant":
            language = sql_text(term.language.value.lower())
        elif term.language is not None:
            language = self._keep(
                ("language", term.language), terms.term_language(term, self.scope, self.context)
            )
        return _Part(sql, multi, kind, terms.term_datatype(term, kind, self.scope, self.context), language)

    def graph_parts(self, graphs: Sequence[TermMap]) -> list[_Part | None]:
        return [None if graph is None else self.part(graph, "graph") for graph in _graph_choices(graphs)]


class Compiler:
    def __init__(
        self,
        mapping: Mapping,
        frames: MappingType[Source, DataFrame],
        context: terms.TermContext,
        subject: str | None = None,
        distinct: bool = False,
    ) -> None:
        self.mapping = mapping
        self.frames = frames
        self.context = context
        self.subject = subject
        branches = [graphs for item in mapping.maps for _, _, graphs in expand_pairs(item)]
        self.may_push_distinct = distinct and len(branches) == 1 and len(branches[0]) <= 1
        self.is_set = False

    def statements(self, spark: SparkSession) -> DataFrame:
        outputs = []
        for source, items in self._by_source().items():
            items = [item for item in items if self._may_match(item) is not False]
            branches = [(item, *branch) for item in items for branch in expand_pairs(item)]
            joined = [branch for branch in branches if isinstance(branch[2], ParentObject) and branch[2].joins]
            plain = [branch for branch in branches if branch not in joined]
            shared = [branch for branch in joined if self._found_once(branch[0], branch[2])]
            if len(plain) + len(shared) < 2:
                shared = []  # a single branch is better off with an inner or semi join
            if plain or shared:
                outputs.append(self._fan_out(source, items, plain, shared))
            for item, predicate, obj, graphs in joined:
                if (item, predicate, obj, graphs) not in shared:
                    outputs.append(self._parent_join(item, predicate, obj, graphs))
        if not outputs:
            return no_statements(spark)
        return reduce(DataFrame.union, outputs)

    def _by_source(self) -> dict[Source, list[TriplesMap]]:
        grouped: dict[Source, list[TriplesMap]] = {}
        for item in self.mapping.maps:
            grouped.setdefault(item.source, []).append(item)
        return grouped

    # --- subject lookup -----------------------------------------------------------------------

    def _may_match(self, item: TriplesMap):
        if self.subject is None:
            return True
        return rewrite.invert_template(item.subject, self.context.base_iri, self.subject)

    def _narrowed(self, item: TriplesMap) -> DataFrame:
        """The source of a triples map, cut down to rows that can have the wanted subject."""
        frame = self.frames[item.source]
        values = self._may_match(item)
        if isinstance(values, dict):
            for name, value in values.items():
                condition = _typed_equals(frame, name, value)
                if condition is not None:
                    frame = frame.where(condition)
        return frame

    # --- fan-out ------------------------------------------------------------------------------

    def _fan_out(self, source: Source, items: Sequence[TriplesMap], plain, shared) -> DataFrame:
        """All branches of one scan; ``shared`` ones take their object from a parent joined onto it."""
        frame = self._narrowed(items[0]) if len(items) == 1 else self.frames[source]
        scope = terms.scope_of(frame.schema)
        branches = [
            (item, predicate, self._object_term(item, obj), graphs) for item, predicate, obj, graphs in plain
        ]
        # What every statement needs is tested on the source columns, where the scan can see it.
        always = [items[0].subject] if len(items) == 1 else []
        if len(branches) == 1 and not shared:
            item, predicate, (obj, _), _ = branches[0]
            alone = [item.subject, predicate, obj]
        else:
            alone = None
        projection = _Projection(scope, self.context)
        structs: list[dict[str, str]] = []
        arrays: list[str] = []
        for item, predicate, (obj, position), graphs in branches:
            parts = [
                projection.part(item.subject, "subject"),
                projection.part(predicate, "predicate"),
                projection.part(obj, position),
            ]
            _add_branch(parts, projection.graph_parts(graphs), structs, arrays)
        single = alone is not None and len(structs) == 1 and not arrays
        frame, known = _with_references(frame, alone if single else always, scope)
        if shared:
            frame, found = self._with_parents(source, frame, scope, list(dict.fromkeys(obj for _, _, obj, _ in shared)))
            for item, predicate, obj, graphs in shared:
                value, kind = found[obj]
                parts = [
                    projection.part(item.subject, "subject"),
                    projection.part(predicate, "predicate"),
                    _Part(projection._keep(("parent", obj), value), False, kind),
                ]
                _add_branch(parts, projection.graph_parts(graphs), structs, arrays)
        if single and self.may_push_distinct:
            item, predicate, (obj, position), graphs = branches[0]
            names = rewrite.statement_references(
                item.subject, predicate, obj, position, _graph_choices(graphs)[0]
            )
            if names and not any(projection.scope[name].multi for name in names):
                frame = frame.select(*[F.col(f"`{name}`") for name in names]).distinct()
                self.is_set = True
        return _generate(frame.select(*projection.columns), structs, arrays, known and single)

    def _object_term(self, item: TriplesMap, obj) -> tuple[TermMap, str]:
        """A plain object, or the parent's subject evaluated on the same row."""
        if isinstance(obj, TermMap):
            return obj, "object"
        other = self.mapping.find(obj.parent)
        if other.source != item.source:
            raise MappingError(
                f"'{item.name}' refers to '{other.name}' without a join, but their sources differ"
            )
        return other.subject, "subject"

    # --- joins --------------------------------------------------------------------------------

    def _found_once(self, item: TriplesMap, obj: ParentObject) -> bool:
        """Whether a child row meets at most one parent, whose subject is one value.

        Such a parent can be joined onto the child's scan without adding rows to it. A streaming parent can't: it
        would be the optional side of an outer join.
        """
        other = self.mapping.find(obj.parent)
        if not self._parent_is_unique(other, obj.joins) or self.frames[other.source].isStreaming:
            return False
        child_scope = terms.scope_of(self.frames[item.source].schema)
        parent_scope = terms.scope_of(self.frames[other.source].schema)
        keys = [terms.look_up(child_scope, join.child) for join in obj.joins]
        keys += [terms.look_up(parent_scope, join.parent) for join in obj.joins]
        return not any(key.multi for key in keys) and not terms.is_multi(other.subject, parent_scope, self.context)

    def _with_parents(
        self,
        source: Source,
        child: DataFrame,
        child_scope: MappingType[str, terms.Reference],
        parents: Sequence[ParentObject],
    ) -> tuple[DataFrame, dict[ParentObject, tuple[Column, str]]]:
        """The child with each of the parents joined on, at most one row each; their subjects, NULL without a parent.

        Joins on one key follow one another, so the child is distributed once for all of them. A parent on the
        child's own key is the child's row itself and needs no join.
        """
        found: dict[ParentObject, tuple[Column, str]] = {}
        by_keys = sorted(enumerate(parents), key=lambda x: (sorted(join.child for join in x[1].joins), x[0]))
        for number, obj in by_keys:
            other = self.mapping.find(obj.parent)
            parent = self.frames[other.source]
            kind = terms.term_kind(other.subject, "subject")
            if other.source == source and self._same_row(source, obj.joins):
                value = terms.term_value(other.subject, "subject", child_scope, self.context)
                there = " AND ".join(f"`{join.child}` IS NOT NULL" for join in obj.joins)
                found[obj] = F.when(F.expr(there), value), kind
                continue
            parent_scope = terms.scope_of(parent.schema)
            child_keys, parent_keys = _comparable_keys(obj.joins, child_scope, parent_scope)
            by_key = {join.parent: join.child for join in obj.joins}
            if self._subject_is_function_of_keys(other.subject, by_key, child_scope, parent_scope):
                names, scope = [], {name: child_scope[by_key[name]] for name in other.subject.references()}
            else:
                names, scope = other.subject.references(), None
            parent, _ = _with_references(parent, [other.subject], parent_scope)
            right, carried = _carried(parent, names, parent_keys, parent_scope, f"_p{number}_", f"_r{number}_")
            same = [key == F.col(f"_r{number}_{i}") for i, key in enumerate(child_keys)]
            child = child.join(right, reduce(lambda a, b: a & b, same), "left")
            value = terms.term_value(other.subject, "subject", carried if scope is None else scope, self.context)
            found[obj] = F.when(F.col(f"_r{number}_0").isNotNull(), value), kind
        return child, found

    def _parent_join(
        self, item: TriplesMap, predicate: TermMap, obj: ParentObject, graphs: Sequence[TermMap]
    ) -> DataFrame:
        """Join on the keys and make terms afterwards, so that only source columns are shuffled."""
        other = self.mapping.find(obj.parent)
        joins = obj.joins
        if item.source == other.source and self._same_row(item.source, joins):
            return self._parent_same_row(item, predicate, other, graphs, [join.child for join in joins])
        child, parent = self._narrowed(item), self.frames[other.source]
        child_scope = terms.scope_of(child.schema)
        parent_scope = terms.scope_of(parent.schema)
        child_keys, parent_keys = _comparable_keys(joins, child_scope, parent_scope)
        graph_terms = _graph_choices(graphs)
        child_terms = [item.subject, predicate, *[g for g in graph_terms if g is not None]]
        child, child_known = _with_references(child, [item.subject, predicate], child_scope)

        by_key = {join.parent: join.child for join in joins}
        only_exists = self._subject_is_function_of_keys(other.subject, by_key, child_scope, parent_scope)
        needed = [name for term in child_terms for name in term.all_references()]
        if only_exists:
            needed += [by_key[name] for name in other.subject.references()]
        left, left_scope = _carried(child, needed, child_keys, child_scope, "_c", "_k")

        object_terms = (other.subject, "subject")
        if only_exists:
            # The parent's subject can be made from the child's key, so the parent only has to exist:
            # a semi join needs no columns but the keys, and no duplicate removal.
            right, _ = _carried(parent, [], parent_keys, parent_scope, "_p", "_r")
            how = "left_semi"
            object_scope = {name: left_scope[by_key[name]] for name in other.subject.references()}
            object_known = True
        else:
            parent, object_known = _with_references(parent, [other.subject], parent_scope)
            right, object_scope = _carried(
                parent, other.subject.references(), parent_keys, parent_scope, "_p", "_r"
            )
            how = "inner"
            if not self._parent_is_unique(other, joins):
                if not rewrite.is_injective(other.subject, "subject"):
                    # Different rows may make one subject, so copies only show in the subject itself.
                    value = terms.term_value(other.subject, "subject", object_scope, self.context)
                    if terms.is_multi(other.subject, object_scope, self.context):
                        value = F.explode(value)
                    keys = [f"_r{i}" for i in range(len(joins))]
                    right = right.select(*keys, value.alias("_o")).where("_o IS NOT NULL")
                    object_terms = None
                right = right.dropDuplicates()
        condition = [F.col(f"_k{i}") == F.col(f"_r{i}") for i in range(len(joins))]
        joined = left.join(right, condition, how)

        projection = _Projection(left_scope, self.context)
        parts = [projection.part(item.subject, "subject"), projection.part(predicate, "predicate")]
        graph_parts = projection.graph_parts(graphs)
        kind = terms.term_kind(other.subject, "subject")
        columns = list(projection.columns)
        multi = False
        if object_terms is None:
            columns.append(F.col("_o"))
        else:
            multi = terms.is_multi(other.subject, object_scope, self.context)
            columns.append(terms.term_value(*object_terms, object_scope, self.context).alias("_o"))
        structs: list[dict[str, str]] = []
        arrays: list[str] = []
        _add_branch([*parts, _Part("_o", multi, kind)], graph_parts, structs, arrays)
        known = child_known and object_known and not arrays and len(graph_parts) == 1
        return _generate(joined.select(*columns), structs, arrays, known)

    def _same_row(self, source: Source, joins) -> bool:
        """Whether a self join can only find the row itself: on equal references that hold a key."""
        if any(join.child != join.parent for join in joins):
            return False
        keys = {join.child for join in joins}
        scope = terms.scope_of(self.frames[source].schema)
        if any(terms.look_up(scope, key).multi for key in keys):
            return False
        return any(set(key) <= keys for key in source.unique)

    def _parent_same_row(
        self,
        item: TriplesMap,
        predicate: TermMap,
        other: TriplesMap,
        graphs: Sequence[TermMap],
        keys: Sequence[str],
    ) -> DataFrame:
        frame = self._narrowed(item).where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
        projection = _Projection(terms.scope_of(frame.schema), self.context)
        parts = [
            projection.part(item.subject, "subject"),
            projection.part(predicate, "predicate"),
            projection.part(other.subject, "subject"),
        ]
        structs: list[dict[str, str]] = []
        arrays: list[str] = []
        graph_parts = projection.graph_parts(graphs)
        _add_branch(parts, graph_parts, structs, arrays)
        frame, known = _with_references(frame, [item.subject, predicate, other.subject], projection.scope)
        known = known and not arrays and len(graph_parts) == 1
        return _generate(frame.select(*projection.columns), structs, arrays, known)

    def _subject_is_function_of_keys(self, subject: TermMap, by_key, child_scope, parent_scope) -> bool:
        if subject.kind not in ("template", "reference"):
            return False
        # one of several values that match says nothing about the others
        if any(child_scope[mine].multi or parent_scope[theirs].multi for theirs, mine in by_key.items()):
            return False
        for name in subject.references():
            if name not in by_key:
                return False
            mine, theirs = child_scope[by_key[name]].dtype, parent_scope[name].dtype
            exact = isinstance(mine, (T.StringType, T.IntegralType, T.DateType))
            both_integral = isinstance(mine, T.IntegralType) and isinstance(theirs, T.IntegralType)
            if not (exact and (mine == theirs or both_integral)):
                return False
        return True

    @staticmethod
    def _parent_is_unique(other: TriplesMap, joins) -> bool:
        keys = {join.parent for join in joins}
        return any(set(key) <= keys for key in other.source.unique)


def _graph_choices(graphs: Sequence[TermMap]) -> list[TermMap | None]:
    """The graph set of a branch; an empty set is the default graph."""
    if not graphs:
        return [None]
    return [None if g.kind == "constant" and g.value == DEFAULT_GRAPH else g for g in graphs]


def _add_branch(
    parts: Sequence[_Part], graphs: Sequence[_Part | None], structs: list[dict[str, str]], arrays: list[str]
) -> None:
    """Add a branch once per graph of its set.

    A graph map without a value adds no graph; a set that stays empty is the default graph. So of
    several graph maps, one without a value is left out, unless it is the first and all are without.
    """
    for i, graph in enumerate(graphs):
        keep = None
        if len(graphs) > 1 and graph is not None and not graph.is_constant and not graph.multi:
            keep = f"{graph.sql} IS NOT NULL"
            others = [other for other in graphs if other is not graph]
            if i == 0 and all(o is not None and not o.is_constant and not o.multi for o in others):
                keep += " OR (" + " AND ".join(f"{other.sql} IS NULL" for other in others) + ")"
        _add_statements(parts, graph, structs, arrays, keep)


def _add_statements(
    parts: Sequence[_Part],
    graph: _Part | None,
    structs: list[dict[str, str]],
    arrays: list[str],
    keep: str | None = None,
) -> None:
    """Add statements of one graph: fields if all terms are single, else an array over the cross product.

    Without ``keep`` the subject stays NULL, so that the statement is dropped like any incomplete one.
    """
    chosen = [*parts] if graph is None else [*parts, graph]
    values = [part.sql if not part.multi else f"x{i}" for i, part in enumerate(chosen)]
    subject, _, obj = parts
    fields = {
        "s_kind": sql_text(subject.kind),
        "s": f"CASE WHEN {keep} THEN {values[0]} END" if keep else values[0],
        "p": values[1],
        "o_kind": sql_text(obj.kind),
        "o": values[2],
    }
    if obj.datatype:
        fields["o_dt"] = sql_text(obj.datatype)
    if obj.language is not None:
        fields["o_lang"] = obj.language
    if graph is not None:
        fields["g"] = f"nullif({values[3]}, {sql_text(DEFAULT_GRAPH)})" if graph.kind == IRI else values[3]
    if not any(part.multi for part in chosen):
        structs.append(fields)
        return
    sql = statement_sql(fields)
    depth = 0
    for i, part in reversed(list(enumerate(chosen))):
        if part.multi:
            # An empty graph set is the default graph.
            values_sql = f"if(size({part.sql}) > 0, {part.sql}, array(NULL))" if part is graph else part.sql
            sql = f"transform({values_sql}, x{i} -> {sql})"
            sql = f"flatten({sql})" if depth else sql
            depth += 1
    arrays.append(f"coalesce({sql}, array())")


def _generate(frame: DataFrame, structs: list[dict[str, str]], arrays: list[str], known: bool) -> DataFrame:
    """Turn the branches of a row into rows. A single plain branch needs no generator at all.

    ``known`` says that no statement can lack a term, so that nothing has to be dropped.
    """
    if len(structs) == 1 and not arrays:
        result = frame.selectExpr(*statement_columns(structs[0]))
    else:
        groups = ([f"array({', '.join(map(statement_sql, structs))})"] if structs else []) + arrays
        statements = groups[0] if len(groups) == 1 else f"concat({', '.join(groups)})"
        result = frame.selectExpr(f"inline({statements})")
    return result if known else complete(result)


def _with_references(
    frame: DataFrame, needed: Sequence[TermMap], scope: MappingType[str, terms.Reference]
) -> tuple[DataFrame, bool]:
    """Keep rows that have every reference of the terms; whether that rules out missing terms.

    A constant, reference or template is missing exactly when one of its references is. A function
    may give NULL for any arguments, and an array may be empty.
    """
    names: dict[str, None] = {}
    known = True
    for term in needed:
        if term.kind == "function":
            known = False
            continue
        for name in term.references():
            known = known and not terms.look_up(scope, name).multi
            names[name] = None
    if names:
        frame = frame.where(" AND ".join(f"`{name}` IS NOT NULL" for name in names))
    return frame, known


def _carried(
    frame: DataFrame,
    names: Sequence[str],
    keys: Sequence[Column | str],
    scope: MappingType[str, terms.Reference],
    column_prefix: str,
    key_prefix: str,
) -> tuple[DataFrame, dict[str, terms.Reference]]:
    """One side of a join: its keys and the columns terms will need, under names of their own.

    A key may be the name of a multi-valued reference: then each of its values is a key.
    """
    names = list(dict.fromkeys(names))
    columns = [F.col(f"`{name}`").alias(f"{column_prefix}{i}") for i, name in enumerate(names)]
    plain = [key.alias(f"{key_prefix}{i}") for i, key in enumerate(keys) if isinstance(key, Column)]
    multi = {i: key for i, key in enumerate(keys) if isinstance(key, str)}
    raw = [F.col(f"`{key}`").alias(f"{key_prefix}{i}") for i, key in multi.items()]
    result = frame.select(*columns, *plain, *raw)
    for i, key in multi.items():
        dtype = terms.look_up(scope, key).dtype
        result = result.withColumn(f"{key_prefix}{i}", F.explode(F.array_distinct(F.col(f"{key_prefix}{i}"))))
        result = result.withColumn(f"{key_prefix}{i}", terms.lexical(F.col(f"{key_prefix}{i}"), dtype))
    carried = {}
    for i, name in enumerate(names):
        reference = terms.look_up(scope, name)
        carried[name] = terms.Reference(f"{column_prefix}{i}", reference.dtype, reference.multi)
    return result, carried


def _comparable_keys(joins, child_scope, parent_scope) -> tuple[list[Column | str], list[Column | str]]:
    """Key columns of equal type. Equal types compare natively, so scans still see the filter.

    A multi-valued key is given by its name; its values compare as text, like the other side then.
    """
    child_keys: list[Column | str] = []
    parent_keys: list[Column | str] = []
    for join in joins:
        mine = terms.look_up(child_scope, join.child)
        theirs = terms.look_up(parent_scope, join.parent)
        integral = isinstance(mine.dtype, T.IntegralType) and isinstance(theirs.dtype, T.IntegralType)
        native = integral or (mine.dtype == theirs.dtype and isinstance(mine.dtype, (T.StringType, T.DateType)))
        native = native and not mine.multi and not theirs.multi
        child_keys.append(join.child if mine.multi else mine.column if native else mine.text())
        parent_keys.append(join.parent if theirs.multi else theirs.column if native else theirs.text())
    return child_keys, parent_keys


def _typed_equals(frame: DataFrame, name: str, value: str) -> Column | None:
    """``name = value`` in the column's own type, so that file statistics can prune."""
    dtype = frame.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return column == value
    if isinstance(dtype, T.IntegralType):
        canonical = value.lstrip("-").isdigit() and str(int(value)) == value
        return column == F.lit(int(value)) if canonical and abs(int(value)) < 2**63 else F.lit(False)
    return None
