"""tidewater: a PySpark-native SQL, vector and corpus-processing engine."""
