"""livetext: transcript, event and corpus analytics as Spark DataFrame programs."""
