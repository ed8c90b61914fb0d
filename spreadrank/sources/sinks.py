"""Result files: CSV, JSON weights, LaTeX and, where openpyxl is installed, a workbook."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame


def slug(name: str) -> str:
    """File name of a dataset: lower case, spaces and hyphens as underscores."""
    return re.sub(r"[ \-]", "_", name.lower())


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, written in parallel; null is an empty field."""
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_weights(weights: DataFrame, path: str) -> str:
    """Learned weights (one row a dataset) as JSON lines."""
    weights.write.mode("overwrite").json(path)
    return path


def latex_table(table: DataFrame, caption: str, label: str) -> str:
    """A booktabs table of a small result table; floats have four places."""
    escape = lambda x: str(x).replace("_", r"\_").replace("%", r"\%")
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else escape(x)
    rows = [" & ".join(show(x) for x in r) + r" \\" for r in table.collect()]
    head = " & ".join(escape(c) for c in table.columns) + r" \\"
    body = ["\\begin{table}", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{l{'r' * (len(table.columns) - 1)}}}", "\\toprule", head, "\\midrule", *rows, "\\bottomrule", "\\end{tabular}", "\\end{table}"]
    return "\n".join(body) + "\n"


def write_workbook(sheets: dict[str, DataFrame], path: str) -> str | None:
    """One sheet for each small table; None where openpyxl is missing."""
    try:
        import openpyxl
    except ImportError:
        return None
    book = openpyxl.Workbook()
    book.remove(book.active)
    for name, df in sheets.items():
        sheet = book.create_sheet(name[:31])
        sheet.append(df.columns)
        for r in df.collect():
            sheet.append(list(r))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    book.save(path)
    return path
