"""Arrow batches in parts of bounded size, inside tasks.

Spark cuts batches by rows, so the texts of one may be small or large.
"""

import numpy as np


def _sizes(column):
    """Bytes of each text, or entries of each list; null has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.list_value_length(column) if lists else pc.binary_length(column)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(batch, column, most):
    """Cut a record batch so that each part holds at most `most` bytes or entries of a column, or one row."""
    ends = np.cumsum(_sizes(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
