"""The physical plan that a query really ran, as text."""

import re


def _indent(line):
    return len(line) - len(line.lstrip(" :+-"))


def executed(df):
    """Runs ``df`` and returns its final plan, the initial plans of its adaptive
    parts (subqueries included) left out."""
    df.collect()
    out, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if skip is not None and (not line.strip() or _indent(line) > skip):
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = _indent(line) - 3  # its header hangs on "+- "
            continue
        out.append(line)
    return "\n".join(out)


def scans(plan):
    """Table scans that ran: those under a reused exchange are not listed again."""
    return len(re.findall(r"FileScan parquet", plan))
