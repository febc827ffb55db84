"""Write docs/PLANS.md: for each headline query, the operators of its
physical plan that matter at scale (scans with pushed filters and read
schema, exchanges, joins, windows, aggregates), from explain('formatted').

usage: python tools/plan_digest.py [sf_dir]
"""
import io
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from kestrel.plans.registry import QUERIES  # noqa: E402
from kestrel.session import get_session  # noqa: E402

KEEP = re.compile(r"^\(\d+\) (Scan|Exchange|BroadcastExchange|.*Join|Window|WindowGroupLimit|HashAggregate|"
                  r"ObjectHashAggregate|SortAggregate|Expand|TakeOrderedAndProject|Generate|MapInPandas|"
                  r"FlatMapGroupsInPandas|Scan ExistingRDD)")


def digest(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    details = []
    for block in text.split("\n\n")[1:]:
        lines = block.strip().splitlines()
        if lines and KEEP.match(lines[0]):
            keep = [lines[0]] + [ln for ln in lines[1:] if ln.startswith(("PushedFilters", "ReadSchema",
                                                                          "Left keys", "Right keys", "Join type",
                                                                          "Arguments", "Keys", "Functions"))]
            details.append("\n".join(k[:220] for k in keep))
    return tree, details


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plan_digest.py` on `{sf}` (before AQE re-planning: join strategies",
           "shown are the static choice; AQE may switch a sort-merge join to a broadcast at runtime when",
           "the build side is measured under the threshold). Eager checkpoints show up as",
           "`Scan ExistingRDD`.", ""]
    for name in HEADLINE:
        tree, details = digest(QUERIES[name](spark, sf))
        out += [f"## {name}", "", "```", tree.strip(), "```", "", "<details><summary>scans, exchanges, joins</summary>",
                "", "```", "\n\n".join(details), "```", "</details>", ""]
    with open("docs/PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
