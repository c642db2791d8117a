"""roomledger: booking analytics as Spark DataFrame jobs.

Shared-resource bookings (rooms, users, reservations, check-ins, audit and
notification rows) are processed as whole tables: interval joins for
availability, reports, audit analytics, validation with quarantine, batch
state machines, derived change rows and Structured Streaming jobs.
"""

import sys

from pyspark import cloudpickle

from roomledger.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

# Functions that run in Python workers travel with their code, so executors
# need neither this package on their path nor the driver's working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
