"""The mapping model: immutable descriptions of what statements to derive from which source.

Nothing here touches data. :meth:`Mapping.run` hands the tree to the compiler, which turns it into
DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping as MappingType, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from quadweave.errors import MappingError
from quadweave.vocab import DEFAULT_BASE_IRI, RDF_TYPE

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

    from quadweave.functions import FunctionRegistry

IRI, BNODE, LITERAL = "iri", "bnode", "literal"


@dataclass(frozen=True)
class TermMap:
    """How one term of a statement is made from a source row."""

    kind: str  # constant | reference | template | function
    value: str
    term_type: str | None = None
    datatype: str | None = None
    language: TermMap | None = None
    args: tuple[tuple[str, TermMap], ...] = ()

    def template_parts(self) -> list[tuple[str, str]]:
        return split_template(self.value)

    def references(self) -> list[str]:
        """Distinct references of the term itself (not of its language), in order of appearance."""
        if self.kind == "reference":
            found = [self.value]
        elif self.kind == "template":
            found = [text for part, text in self.template_parts() if part == "ref"]
        else:
            found = [name for _, arg in self.args for name in arg.references()]
        return list(dict.fromkeys(found))

    def all_references(self) -> list[str]:
        extra = self.language.all_references() if self.language else []
        return list(dict.fromkeys(self.references() + extra))


def split_template(text: str) -> list[tuple[str, str]]:
    """Split a template into ("text", literal) and ("ref", name) parts; ``\\{`` and ``\\}`` are plain braces."""
    parts: list[tuple[str, str]] = []
    for token in re.findall(r"\\[{}\\]|\{(?:\\.|[^{}\\])*\}|[^{}\\]+|.", text, flags=re.S):
        if token.startswith("{") and token.endswith("}") and len(token) > 2:
            parts.append(("ref", re.sub(r"\\(.)", r"\1", token[1:-1])))
            continue
        if token in "{}":
            raise MappingError(f"unbalanced brace or empty reference in template '{text}'")
        plain = token[1] if len(token) == 2 and token[0] == "\\" else token
        if parts and parts[-1][0] == "text":
            parts[-1] = ("text", parts[-1][1] + plain)
        else:
            parts.append(("text", plain))
    return parts


def _language(value: str | TermMap | None) -> TermMap | None:
    return TermMap("constant", value, LITERAL) if isinstance(value, str) else value


def const(iri: str) -> TermMap:
    return TermMap("constant", iri, IRI)


def literal(text: str, *, datatype: str | None = None, language: str | None = None) -> TermMap:
    return TermMap("constant", text, LITERAL, datatype, _language(language))


def ref(
    name: str,
    *,
    term_type: str | None = None,
    datatype: str | None = None,
    language: str | TermMap | None = None,
) -> TermMap:
    return TermMap("reference", name, term_type, datatype, _language(language))


def template(
    text: str,
    *,
    term_type: str | None = None,
    datatype: str | None = None,
    language: str | TermMap | None = None,
) -> TermMap:
    split_template(text)
    return TermMap("template", text, term_type, datatype, _language(language))


def call(
    function: str,
    *,
    term_type: str | None = None,
    datatype: str | None = None,
    language: str | TermMap | None = None,
    **params: TermMap | str,
) -> TermMap:
    """Apply a registered function; a plain string parameter is a reference."""
    args = tuple((key, ref(arg) if isinstance(arg, str) else arg) for key, arg in params.items())
    return TermMap("function", function, term_type, datatype, _language(language), args)


@dataclass(frozen=True)
class Source:
    """A logical source: where rows come from and what one iteration is.

    ``unique`` declares keys of the source (tuples of references). They are trusted, never guessed,
    and only used to leave out work: duplicate removal, or the copy of a row a self join would find.
    """

    name: str | None
    formulation: str = "table"  # table | csv | json | xml
    iterator: str | None = None
    column: str | None = None
    options: tuple[tuple[str, object], ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


def _keys(unique: Iterable[str | Sequence[str]]) -> tuple[tuple[str, ...], ...]:
    return tuple((key,) if isinstance(key, str) else tuple(key) for key in unique)


def table(name: str | None = None, *, unique: Iterable[str | Sequence[str]] = ()) -> Source:
    """A DataFrame the caller binds at run time; ``None`` is the unnamed input."""
    return Source(name, unique=_keys(unique))


def csv_source(name: str | None, *, unique: Iterable[str | Sequence[str]] = (), **options: object) -> Source:
    return Source(name, "csv", options=tuple(sorted(options.items())), unique=_keys(unique))


def json_source(
    name: str | None,
    iterator: str = "$",
    *,
    column: str | None = None,
    unique: Iterable[str | Sequence[str]] = (),
    **options: object,
) -> Source:
    if isinstance(options.get("types"), dict):
        options["types"] = tuple(sorted(options["types"].items()))
    return Source(name, "json", iterator, column, tuple(sorted(options.items())), _keys(unique))


def xml_source(
    name: str | None, iterator: str, *, unique: Iterable[str | Sequence[str]] = (), **options: object
) -> Source:
    return Source(name, "xml", iterator, options=tuple(sorted(options.items())), unique=_keys(unique))


@dataclass(frozen=True)
class Join:
    child: str
    parent: str


@dataclass(frozen=True)
class ParentObject:
    """An object that is the subject of another triples map, found by an equi-join."""

    parent: str
    joins: tuple[Join, ...] = ()


def parent(name: str, *joins: tuple[str, str] | Join) -> ParentObject:
    return ParentObject(name, tuple(j if isinstance(j, Join) else Join(*j) for j in joins))


ObjectMap = TermMap | ParentObject


@dataclass(frozen=True)
class PredicateObjectMap:
    predicates: tuple[TermMap, ...]
    objects: tuple[ObjectMap, ...]
    graphs: tuple[TermMap, ...] = ()


@dataclass(frozen=True)
class TriplesMap:
    name: str
    source: Source
    subject: TermMap
    classes: tuple[str, ...] = ()
    graphs: tuple[TermMap, ...] = ()
    pairs: tuple[PredicateObjectMap, ...] = ()

    def add(
        self,
        predicates: str | TermMap | Sequence[str | TermMap],
        objects: ObjectMap | Sequence[ObjectMap],
        graphs: str | TermMap | Sequence[str | TermMap] = (),
    ) -> TriplesMap:
        """A copy with one more predicate-object map; a plain string is a constant IRI."""
        pair = PredicateObjectMap(_terms(predicates), _listed(objects), _terms(graphs))
        return replace(self, pairs=self.pairs + (pair,))


def _listed(value):
    return tuple(value) if isinstance(value, (list, tuple)) else (value,)


def _terms(value) -> tuple[TermMap, ...]:
    return tuple(const(v) if isinstance(v, str) else v for v in _listed(value))


def triples_map(
    name: str,
    source: Source,
    subject: TermMap,
    *,
    classes: str | Sequence[str] = (),
    graphs: str | TermMap | Sequence[str | TermMap] = (),
) -> TriplesMap:
    classes = (classes,) if isinstance(classes, str) else tuple(classes)
    return TriplesMap(name, source, subject, classes, _terms(graphs))


@dataclass(frozen=True)
class Mapping:
    """A set of triples maps."""

    maps: tuple[TriplesMap, ...]
    _by_name: dict = field(init=False, repr=False, compare=False, hash=False, default_factory=dict)
    _residual: tuple = field(repr=False, compare=False, default=())

    def __post_init__(self):
        for item in self.maps:
            if item.name in self._by_name:
                raise MappingError(f"two triples maps are named '{item.name}'")
            self._by_name[item.name] = item

    @staticmethod
    def of(*maps: TriplesMap) -> Mapping:
        return Mapping(tuple(maps))

    @staticmethod
    def from_statements(statements: DataFrame) -> Mapping:
        """Build a mapping from the statements of a mapping document."""
        from quadweave.plans.documents import mapping_from_statements

        return mapping_from_statements(statements)

    def find(self, name: str) -> TriplesMap:
        try:
            return self._by_name[name]
        except KeyError:
            raise MappingError(f"there is no triples map named '{name}'") from None

    def select(
        self,
        *,
        predicates: Iterable[str] | None = None,
        classes: Iterable[str] | None = None,
        graphs: Iterable[str | None] | None = None,
    ) -> Mapping:
        """Keep only what can produce the wanted predicates, classes and graphs.

        Branches are dropped from the mapping itself, so their columns are never read. ``classes``
        keeps other predicates unless ``predicates`` is given as well. ``None`` is the default graph.
        """
        from quadweave.plans.rewrite import prune

        return prune(self, predicates, classes, graphs)

    def with_source_options(self, options: MappingType[str | None, MappingType[str, object]]) -> Mapping:
        """The mapping with reader options and keys by source name, which mapping documents have no words for.

        ``unique`` declares keys as in :func:`table`; everything else is an option of the source's reader.
        """
        missing = set(options) - {item.source.name for item in self.maps}
        if missing:
            raise MappingError(f"the mapping has no source named {sorted(map(str, missing))}")

        def extended(source: Source) -> Source:
            given = dict(options.get(source.name, {}))
            unique = _keys(given.pop("unique", ())) or source.unique
            if isinstance(given.get("types"), dict):
                given["types"] = tuple(sorted(given["types"].items()))
            return replace(source, options=tuple(sorted({**dict(source.options), **given}.items())), unique=unique)

        return replace(self, maps=tuple(replace(item, source=extended(item.source)) for item in self.maps))

    def run(
        self,
        spark: SparkSession,
        sources: MappingType[str | None, DataFrame] | None = None,
        *,
        root: str | None = None,
        base_iri: str = DEFAULT_BASE_IRI,
        functions: FunctionRegistry | None = None,
        configure: Sequence[Callable] = (),
        limit: int | None = None,
        distinct: bool = False,
        subject: str | None = None,
        on_invalid: str = "keep",
        iri_safe: str = "ascii",
        natural_types: bool = True,
    ) -> DataFrame:
        """The statements of this mapping as a lazy DataFrame (streaming if a bound source streams)."""
        from quadweave.plans.compile import run_mapping

        return run_mapping(
            self,
            spark,
            sources or {},
            root=root,
            base_iri=base_iri,
            functions=functions,
            configure=configure,
            limit=limit,
            distinct=distinct,
            subject=subject,
            on_invalid=on_invalid,
            iri_safe=iri_safe,
            natural_types=natural_types,
        )


def expand_pairs(item: TriplesMap):
    """Yield (predicate, object, graph set) for every class and predicate-object combination."""
    subject_graphs = item.graphs
    for cls in item.classes:
        yield const(RDF_TYPE), const(cls), subject_graphs
    for pair in item.pairs:
        graphs = tuple(dict.fromkeys(subject_graphs + pair.graphs))
        for predicate in pair.predicates:
            for obj in pair.objects:
                yield predicate, obj, graphs
