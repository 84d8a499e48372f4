"""Motor-carrier registration and safety analytics as PySpark DataFrame jobs."""
