"""Self-citation and erratum analytics over bibliographic records, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow UDFs travel to the workers with their code, so a job needs no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
