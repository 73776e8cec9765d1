"""Syntax trees. ``str`` of an expression is its canonical text, which names unaliased columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # None, bool, int, float, str, bytes

    def __str__(self) -> str:
        v = self.value
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, bytes):
            return f"'\\x{v.hex()}'"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"
        return repr(v)


@dataclass(frozen=True)
class Name(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Param(Expr):
    index: int

    def __str__(self) -> str:
        return f"${self.index}"


@dataclass(frozen=True)
class Star(Expr):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Paren(Expr):
    inner: Expr

    def __str__(self) -> str:
        return f"({self.inner})"


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr

    def __str__(self) -> str:
        return f"NOT {self.inner}"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op.upper()} {self.right}"


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr

    def __str__(self) -> str:
        return f"{self.value} BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    items: tuple[Expr, ...]
    negated: bool

    def __str__(self) -> str:
        return f"{self.value} {'NOT ' * self.negated}IN ({', '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Cast(Expr):
    value: Expr
    type: str

    def __str__(self) -> str:
        return f"CAST({self.value} AS {self.type})"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        from ..functions.aggregates import AGGREGATES

        name = self.name.upper() if self.name in AGGREGATES else self.name
        return f"{name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Output:
    expr: Expr
    alias: str | None

    @property
    def name(self) -> str:
        return self.alias if self.alias is not None else str(self.expr)


@dataclass(frozen=True)
class Core:
    """One SELECT without what orders it."""

    outputs: tuple[Output, ...]
    table: str | None
    where: Expr | None = None
    group: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Select:
    cores: tuple[Core, ...]
    unions: tuple[str, ...] = ()  # between cores: "distinct" or "all"
    order: tuple[str, bool] | None = None  # column, descending
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]
    select: Select | None
    conflict: str | None  # nothing, replace
    returning: tuple[Output, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None
    order: tuple[str, bool] | None = None
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: Expr | None = None


@dataclass
class Key:
    """A primary key or unique constraint: (column, descending) pairs."""

    name: str | None
    columns: list[tuple[str, bool]]


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef] = field(default_factory=list)
    primary: Key | None = None
    uniques: list[Key] = field(default_factory=list)
    checks: list[tuple[str | None, Expr]] = field(default_factory=list)


@dataclass
class CreateTable:
    table: TableDef
    if_not_exists: bool


@dataclass
class CreateIndex:
    name: str | None
    table: str
    columns: list[tuple[str, bool]]
    unique: bool
    if_not_exists: bool


@dataclass
class CreateSequence:
    name: str
    options: dict[str, object]
    if_not_exists: bool


@dataclass
class Drop:
    kind: str
    name: str
    if_exists: bool


@dataclass
class AlterRename:
    table: str
    to: str


@dataclass
class AlterAdd:
    table: str
    part: TableDef  # one column and what its definition says


@dataclass
class Reindex:
    name: str | None


@dataclass
class Begin:
    write: bool


@dataclass
class Commit:
    pass


@dataclass
class Rollback:
    pass


@dataclass
class Explain:
    statement: object
