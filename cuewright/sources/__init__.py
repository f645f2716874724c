"""Sources and sinks: media containers, symbol tables, job queues."""
