"""Print the query names of plan modules."""
import re
import sys

for m in sys.argv[1:]:
    print(" ".join(re.findall(r'@query\("(\w+)"', open(f"/root/repo/undulate/plans/{m}.py").read())))
