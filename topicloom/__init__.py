"""Part of topicloom: conversation-concept analytics on Spark."""
