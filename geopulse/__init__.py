"""geopulse: Spark jobs for geo-tagged social posts and official area statistics."""
