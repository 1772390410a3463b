"""A Spark engine for catalogues of dated listings: normalise, resolve, tag, score, select and maintain them."""
