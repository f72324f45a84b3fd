"""The syntax tree of a search: a handful of immutable nodes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The names of the language.
TEXT_PROPERTIES = frozenset("artist album title kind author subject keywords creator producer genre copyright composer cameramake cameramodel".split())
NUMBER_PROPERTIES = frozenset("width height duration pages orientation iso focallength aperture exposuretime".split())
METRICS = frozenset("childcount childfilecount childfoldercount descendantcount descendantfilecount descendantfoldercount foldersize".split())
RELATIONS = {
    "child": (False, None), "childfile": (False, False), "childfolder": (False, True),
    "descendant": (True, None), "descendantfile": (True, False), "descendantfolder": (True, True),
}
FLAGS = {"hidden": 0x8000, "immutable": 0x20002, "append": 0x40004, "nodump": 0x1, "compressed": 0x20, "dataless": 0x40000000, "placeholder": 0x40000000}
HIDDEN_FLAG = 0x8000


class QueryError(ValueError):
    """A search that can't be read."""


@dataclass(frozen=True)
class Options:
    """How text terms match; modifiers change it for a term or a group."""

    field: str = "name"  # name, path or parent
    target: str | None = None  # extension, content or a text property, else the field
    case: bool = False
    marks: bool = False
    regex: bool = False
    word_start: bool = False
    word_end: bool = False
    whole: bool = False
    start: bool = False
    end: bool = False
    wildcards: bool = True
    dot_all: bool = False
    multiline: bool = False


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class All(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True)
class Text(Node):
    """`text` in the option's target or field, matched as the options say."""

    text: str
    options: Options

    @property
    def target(self) -> str:
        return self.options.target or self.options.field


@dataclass(frozen=True)
class ExtensionIn(Node):
    values: tuple[str, ...]


@dataclass(frozen=True)
class IsFolder(Node):
    yes: bool


@dataclass(frozen=True)
class IsSymlink(Node):
    pass


@dataclass(frozen=True)
class IsHidden(Node):
    pass


@dataclass(frozen=True)
class HasFlags(Node):
    mask: int


@dataclass(frozen=True)
class Number(Node):
    """The value lies in the range, or, negated, is known and lies outside."""

    field: str
    low: float
    high: float
    with_low: bool = True
    with_high: bool = True
    negated: bool = False


@dataclass(frozen=True)
class Unknown(Node):
    field: str
    negated: bool = False


@dataclass(frozen=True)
class Related(Node):
    """Folders that have a child (or any entry below) for which `part` holds."""

    part: Node
    recursive: bool


@dataclass(frozen=True)
class Needs:
    """What has to be at hand to evaluate a search."""

    content: bool = False
    properties: bool = False
    relations: bool = False
    dates: bool = False

    def __or__(self, other: Needs) -> Needs:
        return Needs(*(getattr(self, f) or getattr(other, f) for f in ("content", "properties", "relations", "dates")))


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, (All, Any)):
        return node.parts
    return (node.part,) if isinstance(node, (Not, Related)) else ()


def needs(node: Node, inside: bool = True) -> Needs:
    """`inside`: whether to look into relations too."""
    own = Needs()
    if isinstance(node, Text):
        own = Needs(content=node.target == "content", properties=node.target in TEXT_PROPERTIES)
    elif isinstance(node, (Number, Unknown)):
        own = Needs(properties=node.field in NUMBER_PROPERTIES, relations=node.field in METRICS, dates=node.field in ("modified", "created"))
    elif isinstance(node, Related):
        own = Needs(relations=True)
        if not inside:
            return own
    for c in children(node):
        own |= needs(c, inside)
    return own


def of_type(node: Node, folder: bool | None) -> Node:
    return node if folder is None else All((IsFolder(folder), node))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "dataclass", "field", "replace")]
