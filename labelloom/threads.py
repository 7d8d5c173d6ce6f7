"""One thread for matrix products inside a task.

Spark runs a task on each core, so a matrix library that starts more threads of its own only makes them
wait for one another: at two threads a task the training step took the same time and twice the CPU.
"""

from __future__ import annotations

import ctypes

# What the library's setter is called in its builds.
SETTERS = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_")


def one_thread() -> bool:
    """Tell the OpenBLAS that numpy has loaded to use one thread; whether one was found.

    Other libraries, and systems that do not list what a process has loaded, are left as they are.
    """
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split(maxsplit=5)[5].strip() for line in maps if "openblas" in line}
    except OSError:
        return False
    found = False
    for path in paths:
        library = ctypes.CDLL(path)
        for name in SETTERS:
            setter = getattr(library, name, None)
            if setter is not None:
                setter(ctypes.c_int(1))
                found = True
    return found
