"""claimloom: claims analytics as set-oriented Spark jobs."""
