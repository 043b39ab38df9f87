"""Tables, snapshots, manifests, deletes, copies, backups."""
