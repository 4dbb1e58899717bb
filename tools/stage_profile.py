"""Jobs / stages / tasks and wall time per registered query (noop sink)."""
import sys, time
sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from kpiloom.session import build_session
from kpiloom.catalog.queries import QUERIES

sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.1"
keys = [a for a in sys.argv[1:] if not a.startswith("/")]
spark = build_session("local[8]", 8)
sc = spark.sparkContext
st = sc.statusTracker()
for i, k in enumerate(keys):
    QUERIES[k](spark, sf).write.format("noop").mode("overwrite").save()  # warm
for i, k in enumerate(keys):
    g = f"g{i}"
    sc.setJobGroup(g, k)
    t0 = time.perf_counter()
    QUERIES[k](spark, sf).write.format("noop").mode("overwrite").save()
    dt = time.perf_counter() - t0
    jobs = st.getJobIdsForGroup(g)
    stages = [s for j in jobs for s in (st.getJobInfo(j).stageIds if st.getJobInfo(j) else [])]
    tasks = sum((st.getStageInfo(s).numTasks if st.getStageInfo(s) else 0) for s in stages)
    print(f"{k:24s} {dt:6.2f}s jobs={len(jobs):3d} stages={len(stages):4d} tasks={tasks}")
