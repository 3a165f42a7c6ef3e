"""What a physical plan, as text, does to a table."""

import re


def moved(plan: str, table: str) -> bool:
    """Whether rows of a table's scan pass an exchange before they meet a join."""
    lines, found = plan.splitlines(), False
    depth = [len(re.match(r"[ :|+\-]*", line)[0]) for line in lines]
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and table in line]
    assert scans, plan
    for k in scans:
        at = depth[k]
        for line, d in zip(reversed(lines[:k]), reversed(depth[:k])):
            if d >= at:
                continue  # another branch's
            at = d
            if "Join" in line:
                break
            found |= "Exchange" in line
    return found
