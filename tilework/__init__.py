"""Slide analytics on Spark."""

import os

# A process that forks (the driver starts its JVM so, workers come from a daemon) can hang in a threaded BLAS; Spark's tasks are the parallelism here.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
