"""Three-token formulas (``a op b``) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import number


def formula(df: DataFrame, text: str) -> Column:
    """``lhs op rhs`` with op one of + - * /; operands are column names or numbers.

    A missing or unreadable operand counts as 0, and division by 0 gives 0.
    """
    tokens = text.split()
    if len(tokens) != 3 or tokens[1] not in "+-*/" or len(tokens[1]) != 1:
        raise ValueError(f"not a formula of the form 'a op b': {text!r}")
    names = {n.strip().lower(): n for n in df.columns}
    types = dict(df.dtypes)

    def operand(token: str) -> Column:
        if token.lower() in names:
            name = names[token.lower()]
            return F.coalesce(number(types[name], F.col(f"`{name}`")), F.lit(0.0))
        try:
            return F.lit(float(token))
        except ValueError:
            raise ValueError(f"neither a column nor a number: {token!r}") from None

    left, right = operand(tokens[0]), operand(tokens[2])
    if tokens[1] == "/":
        return F.coalesce(F.try_divide(left, right), F.lit(0.0))
    return {"+": left + right, "-": left - right, "*": left * right}[tokens[1]]


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return df.withColumns({name: formula(df, text) for name, text in formulas.items()})
