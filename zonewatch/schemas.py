"""Schemas of files and messages read from outside."""

FRAME_RESULT = (
    "camera_id string, location_id string, frame_id string, sequence_number bigint, captured_at string, "
    "received_at string, frame_width int, frame_height int, inference_ms double, "
    "detections array<struct<class_id:int,class_name:string,confidence:double,bbox_xyxy:array<double>,track_id:bigint>>"
)
FRAME_METADATA = (
    "frame_id string, camera_id string, location_id string, source_type string, source_url string, timestamp string, "
    "captured_at string, received_at string, sequence_number bigint, source_width int, source_height int, "
    "frame_width int, frame_height int, target_fps double, fps double, encoding string, tenant_id string"
)
CAMERA_ITEM = (
    "camera_id string, location_id string, name string, source_type string, source_url string, target_fps double, "
    "frame_width int, frame_height int, encoding string, enabled boolean"
)
SENSOR_READING = (
    "reading_id string, device_id string, sensor_id string, sensor_type string, location_id string, zone_id string, "
    "value string, unit string, status string, timestamp string, recordedAt string"
)
DEVICE_STATUS = "device_id string, status string, battery_percent int, signal_strength int, timestamp string"
ENVELOPE = (
    "message_id string, message_type string, schema_version string, correlation_id string, timestamp string, "
    "producer string, data string"
)
GROUND_TRUTH = "video string, zone string, event_type string, start_s double, end_s double, note string"
POLYGON = "struct<points:array<struct<x:double,y:double>>>"
POINTS = "array<struct<x:double,y:double>>"
EVIDENCE_COLUMNS = (
    "id", "ai_event_id", "alert_id", "camera_id", "evidence_type", "storage_key", "mime_type", "file_size",
    "frame_id", "sequence_number", "captured_us", "started_us", "ended_us", "duration_seconds", "codec", "fps",
    "frame_width", "frame_height", "status", "created_us",
)
