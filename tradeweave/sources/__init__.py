"""Sources and sinks: files, landed JSON payloads, reference tables, stand-in inputs."""
