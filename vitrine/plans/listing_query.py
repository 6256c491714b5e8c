"""The interactive query over the listing view: scope, filters, order, aggregates and their query string."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 1e9
SCOPES = ("meus", "outros", "favoritos", "lixeira")
ORDERS = ("relevancia", "preco", "m2", "area", "tempo")
SIGNALS = ("novos", "quedas", "multi")


@dataclass(frozen=True)
class ListingQuery:
    """A query; the defaults ask for everything in scope by relevance.

    The view needs ``titulo, bairro, cidade, logradouro, sites (array), preco,
    preco_m2, area_m2, quartos, dias, fontes, score, novo, queda, melhor,
    atende, no_recorte, favorito, descartado`` and a unique ``id``.
    """

    cidade: str = ""
    bairro: str = ""
    quartos: int | None = None
    min: float | None = None
    max: float | None = None
    q: str = ""
    ordem: str = "relevancia"
    sinais: tuple[str, ...] = field(default=())
    escopo: str = "meus"
    aba: str = ""

    @classmethod
    def from_query_string(cls, text: str) -> ListingQuery:
        """Reads a query string; unknown keys and unreadable values give the default."""
        given = {k: v[-1] for k, v in parse_qs(text.lstrip("?")).items()}

        def number(name: str, kind):
            try:
                return kind(given[name])
            except (KeyError, ValueError):
                return None

        return cls(
            cidade=given.get("cidade", ""),
            bairro=given.get("bairro", ""),
            quartos=number("quartos", int),
            min=number("min", float),
            max=number("max", float),
            q=given.get("q", ""),
            ordem=given["ordem"] if given.get("ordem") in ORDERS else "relevancia",
            sinais=tuple(s for s in given.get("sinais", "").split(",") if s in SIGNALS),
            escopo=given["escopo"] if given.get("escopo") in SCOPES else "meus",
            aba=given.get("aba", ""),
        )

    def to_query_string(self) -> str:
        """The query string, defaults left out."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value not in (f.default, None, "", ()):
                out[f.name] = ",".join(value) if f.name == "sinais" else f"{value:g}" if isinstance(value, float) else value
        return urlencode(out)

    def active_filters(self) -> int:
        """Number of filters that narrow the list (scope, order and tab aside)."""
        return sum(bool(x) for x in (self.cidade, self.bairro, self.q)) + sum(x is not None for x in (self.quartos, self.min, self.max)) + len(self.sinais)

    def scope(self) -> Column:
        """Which rows the scope holds: the bin has the discarded, everything else hides them."""
        kept = ~F.col("descartado")
        return {"lixeira": F.col("descartado"), "favoritos": kept & F.col("favorito"), "outros": kept & ~F.col("no_recorte"), "meus": kept & F.col("no_recorte")}[self.escopo]

    def predicate(self) -> Column:
        """All filters; an unknown number meets no bound."""
        p = self.scope()
        if "novos" in self.sinais:
            p = p & F.col("novo")
        if "quedas" in self.sinais:
            p = p & (F.col("queda") > 0)
        if "multi" in self.sinais:
            p = p & (F.col("fontes") >= 2)
        if self.quartos is not None:
            p = p & (F.col("quartos") >= self.quartos)
        for name in ("cidade", "bairro"):
            if getattr(self, name):
                p = p & (F.col(name) == getattr(self, name))
        if self.min is not None:
            p = p & (F.col("preco") >= self.min)
        if self.max is not None:
            p = p & (F.col("preco") <= self.max)
        if self.q:
            text = F.lower(F.concat_ws(" ", "titulo", "bairro", "cidade", "logradouro", "sites"))
            p = p & F.contains(text, F.lit(self.q.strip().lower()))
        return F.coalesce(p, F.lit(False))

    def order(self) -> list[Column]:
        """The order, ended by the id so that it is total."""
        far = lambda c: F.coalesce(F.col(c), F.lit(FAR)).asc()
        near = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
        relevance = [F.col("atende").desc(), F.col("melhor").desc(), near("score"), F.col("novo").desc(), (F.coalesce(F.col("queda"), F.lit(0)) > 0).desc(), far("preco")]
        by = {"relevancia": relevance, "preco": [far("preco")], "m2": [far("preco_m2")], "area": [near("area_m2")], "tempo": [F.coalesce(F.col("dias"), F.lit(0)).asc()]}
        return [*by[self.ordem], F.col("id").asc()]

    def apply(self, view: DataFrame) -> DataFrame:
        """The rows asked for, in order."""
        return view.where(self.predicate()).orderBy(*self.order())


def upper_median(column: str) -> Column:
    """The upper of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def pulse(rows: DataFrame) -> DataFrame:
    """One row about the rows shown: count, new, dropped, multi-source, upper median of price per m2, price range."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("novo").alias("novos"),
        F.count_if(F.col("queda") > 0).alias("quedas"),
        F.count_if(F.col("fontes") > 1).alias("multi"),
        upper_median("preco_m2").alias("mediana_m2"),
        F.min("preco").alias("preco_min"),
        F.max("preco").alias("preco_max"),
    )


def scope_counts(view: DataFrame) -> DataFrame:
    """Rows per scope, in one pass."""
    kept = ~F.col("descartado")
    return view.agg(F.count_if(kept & F.col("no_recorte")).alias("meus"), F.count_if(kept & ~F.col("no_recorte")).alias("outros"), F.count_if(kept & F.col("favorito")).alias("favoritos"), F.count_if("descartado").alias("lixeira"))


def facet(view: DataFrame, query: ListingQuery, column: str) -> DataFrame:
    """Distinct values of a column within the query's scope and city, sorted."""
    rows = view.where(query.scope())
    if query.cidade and column != "cidade":
        rows = rows.where(F.col("cidade") == query.cidade)
    return rows.select(column).where(f"{column} is not null and {column} <> ''").distinct().orderBy(column)


def badges(view: DataFrame) -> DataFrame:
    """``view`` with the marks a card shows: up to two of drop, new, best, then the context marks."""
    marks = F.array_compact(F.array(F.when(F.col("queda") > 0, F.lit("queda")), F.when(F.col("novo"), F.lit("novo")), F.when(F.col("melhor"), F.lit("melhor"))))
    context = F.array_compact(F.array(F.when(F.col("fontes") > 1, F.lit("multi")), F.when(F.col("dias") > 60, F.lit("antigo"))))
    return view.withColumns({"selos": F.slice(marks, 1, 2), "contexto": context})
