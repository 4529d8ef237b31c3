"""Store configuration, with a round trip through quads."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from quadlake.errors import ConfigError
from quadlake.functions.terms import XSD, bnode, decode, literal, uri

#: The type of store, checked by open_store.
STORE_TYPE = "quadlake:QuadStore"
SCHEMA = "http://quadlake.example/config#"
_FIELDS = ("s", "p", "o", "c")


@dataclass(frozen=True)
class Layout:
    """How the files of a copy of the quads are laid out: sorted by ``sort``,
    cut into ``partitions`` ranges of its first column (0: by Spark's choice)."""

    sort: tuple[str, ...] = ("p", "s", "o", "c")
    partitions: int = 0

    def __post_init__(self) -> None:
        if not self.sort or set(self.sort) - set(_FIELDS) or len(set(self.sort)) != len(self.sort):
            raise ConfigError(f"sort must name s, p, o, c at most once each, not {self.sort}")
        if self.partitions < 0:
            raise ConfigError("partitions must not be negative")


@dataclass(frozen=True)
class StoreConfig:
    """path: folder that holds catalogs; catalog: name of the store in it."""

    path: str
    catalog: str = "default"
    layouts: tuple[Layout, ...] = field(default_factory=lambda: (Layout(),))
    type: str = STORE_TYPE

    def __post_init__(self) -> None:
        if not self.path:
            raise ConfigError("a path is needed")
        if not self.catalog or "/" in self.catalog:
            raise ConfigError(f"not a catalog name: {self.catalog!r}")
        if not self.layouts:
            raise ConfigError("at least one layout is needed")

    def options(self) -> dict:
        return asdict(self)

    @classmethod
    def from_options(cls, options: dict) -> StoreConfig:
        known = {"path", "catalog", "layouts", "type"}
        if unknown := set(options) - known:
            raise ConfigError(f"unknown options {sorted(unknown)}")
        layouts = [x if isinstance(x, Layout) else Layout(tuple(x.get("sort", Layout().sort)), int(x.get("partitions", 0))) for x in options.get("layouts", [{}])]
        return cls(options.get("path", ""), options.get("catalog", "default"), tuple(layouts), options.get("type", STORE_TYPE))

    # ----------------------------------------------------------------- as quads
    def to_quads(self, node: str = bnode("config")) -> list[tuple[str, str, str]]:
        def p(name: str) -> str:
            return uri(SCHEMA, name)

        out = [(node, p("type"), literal(self.type)), (node, p("path"), literal(self.path)), (node, p("catalog"), literal(self.catalog))]
        for i, x in enumerate(self.layouts):
            at = f"{node}-layout{i}" if node.startswith("_:") else bnode(f"layout{i}")
            out += [(node, p("layout"), at), (at, p("position"), literal(str(i), datatype=XSD + "integer"))]
            out += [(at, p("sort"), literal(" ".join(x.sort))), (at, p("partitions"), literal(str(x.partitions), datatype=XSD + "integer"))]
        return out

    @classmethod
    def from_quads(cls, quads: Iterable[tuple[str, str, str]], node: str = bnode("config")) -> StoreConfig:
        quads = list(quads)

        def values(s: str, name: str) -> list[str]:
            return [o for a, p, o in quads if a == s and p == uri(SCHEMA, name)]

        def value(s: str, name: str, default: str | None = None) -> str:
            found = values(s, name)
            if len(found) > 1 or not found and default is None:
                raise ConfigError(f"{len(found)} values of {name}")
            return decode(found[0]).value if found else default

        places = sorted(values(node, "layout"), key=lambda x: int(value(x, "position", "0")))
        layouts = [Layout(tuple(value(x, "sort").split()), int(value(x, "partitions", "0"))) for x in places]
        return cls(value(node, "path"), value(node, "catalog", "default"), tuple(layouts) or (Layout(),), value(node, "type", STORE_TYPE))
